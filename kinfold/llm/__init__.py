"""Operators of a training-data pipeline over text, conversations and vectors.

Nothing outside this package imports it. Every operator reads only the columns that its
parameters name and returns its key columns plus its own outputs, so other columns of the
input, whatever their names, neither clash nor get lost in it.
"""
