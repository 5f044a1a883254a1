"""One-hot encoding of positional fields, weighted by rarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import before


def counted(rows: DataFrame, seq_col: str = "seq", fields_col: str = "fields") -> DataFrame:
    """(field_pos, term, cnt, term_id, record_count, dim): terms numbered by first appearance.
    Empty and null values are not counted."""
    cells = rows.select(F.col(seq_col).alias("seq"), F.posexplode(fields_col).alias("field_pos", "term")).where("term <> ''")
    counts = cells.groupBy("field_pos", "term").agg(F.count("*").alias("cnt"), F.min("seq").alias("first"))
    numbered = before(counts, "field_pos", ["first", "term"]).selectExpr("field_pos", "term", "cnt", "before as term_id")
    sums = counts.groupBy("field_pos").agg(F.sum("cnt").alias("record_count"), F.count("*").alias("dim"))
    return numbered.join(F.broadcast(sums), "field_pos")


class Encoder:
    """Learnt counts and what is derived from them."""

    def __init__(self, counts: DataFrame):
        self.counts = counts

    @property
    def weights(self) -> DataFrame:
        """``counts`` with weight ln(record_count / cnt) and field_offset, the first component of
        the field: the distinct terms of all fields before it."""
        dims = self.counts.select("field_pos", "dim").distinct()
        starts = dims.withColumn("field_offset", F.expr("cast(coalesce(sum(dim) over (order by field_pos rows between unbounded preceding and 1 preceding), 0) as bigint)")).drop("dim")
        return self.counts.join(F.broadcast(starts), "field_pos").withColumn("weight", F.log(F.col("record_count") / F.col("cnt")))

    def encode(self, rows: DataFrame, seq_col: str = "seq", fields_col: str = "fields") -> DataFrame:
        """(seq, vector): per row a sparse vector with one component per field, in field order.

        An unknown term takes the field's term 0; an empty value leaves a component (0, 0).
        """
        known = self.weights.select("field_pos", "term", (F.col("field_offset") + F.col("term_id")).alias("index"), "weight")
        zero = self.weights.where("term_id = 0").select("field_pos", F.col("field_offset").alias("index0"), F.col("weight").alias("weight0"))
        cells = rows.select(F.col(seq_col).alias("seq"), F.posexplode(fields_col).alias("field_pos", "term"))
        found = cells.join(known, ["field_pos", "term"], "left").join(F.broadcast(zero), "field_pos", "left")
        empty = F.coalesce(F.col("term") == "", F.lit(True))
        index = F.when(empty, F.lit(0)).otherwise(F.coalesce("index", "index0", F.lit(0))).cast("bigint")
        weight = F.when(empty, F.lit(0.0)).otherwise(F.coalesce("weight", "weight0", F.lit(0.0)))
        cell = F.struct("field_pos", index.alias("index"), weight.alias("value"))
        size = self.counts.select("field_pos", "dim").distinct().agg(F.sum("dim")).first()[0] or 0
        out = found.groupBy("seq").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        pairs = F.transform("cells", lambda c: F.struct(c["index"].alias("index"), c["value"].alias("value")))
        return out.select("seq", F.struct(F.lit(size).cast("bigint").alias("dimension"), pairs.alias("components")).alias("vector"))

    def save(self, path: str) -> None:
        self.counts.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoder:
        return cls(spark.read.parquet(path))


def learn(rows: DataFrame, seq_col: str = "seq", fields_col: str = "fields") -> Encoder:
    return Encoder(counted(rows, seq_col, fields_col))
