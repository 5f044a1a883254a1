"""Approximate record matching on Spark: declarative string transforms, learnt term weights,
signed-random-projection signatures and a chunk index, all as DataFrame plans."""
