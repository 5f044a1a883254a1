"""Learning: how often each term of each field occurs, and what follows from that."""

from __future__ import annotations

import json
from functools import cached_property
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import transforms
from kinfold.plans.definitions import SchemaDef

from .lineage import before, cut


def field_terms(records: DataFrame, schema: SchemaDef, id_col: str = "id", outer: bool = False) -> DataFrame:
    """(id, field_idx, pos, term): every term of every field, in order, '' included. With
    ``outer`` a field without terms has one row with null pos and term."""
    lists = F.array(*(transforms.terms(f, records.columns) for f in schema.fields))
    per_field = records.select(F.col(id_col).alias("id"), F.posexplode(lists).alias("field_idx", "terms"))
    explode = F.posexplode_outer if outer else F.posexplode
    return per_field.select("id", "field_idx", explode("terms").alias("pos", "term"))


class Vocabulary:
    """A schema with its learnt counts (field_idx, term, cnt); all else is derived."""

    def __init__(self, schema: SchemaDef, counts: DataFrame):
        self.schema, self.counts = schema, counts

    @cached_property
    def fields(self) -> DataFrame:
        """(field_idx, total, dim, field_offset) of every field, learnt or not: occurrences,
        distinct terms, and the first component of the field's hyperplanes."""
        spark = self.counts.sparkSession
        sums = self.counts.groupBy("field_idx").agg(F.sum("cnt").alias("total"), F.count("*").alias("dim"))
        every = spark.range(len(self.schema.fields)).select(F.col("id").cast("int").alias("field_idx"))
        rows = every.join(F.broadcast(sums), "field_idx", "left").na.fill(0, ["total", "dim"])
        offset = f"cast(coalesce(sum(dim * {self.schema.hash_count}) over (order by field_idx rows between unbounded preceding and 1 preceding), 0) as bigint)"
        return cut(rows.withColumn("field_offset", F.expr(offset)))

    @cached_property
    def table(self) -> DataFrame:
        """(field_idx, term, cnt, term_idx, total, dim, weight): term_idx is the term's place by its
        bytes, weight is ln(total / cnt)."""
        ranked = before(self.counts, "field_idx", ["term"]).withColumnRenamed("before", "term_idx")
        rows = ranked.join(F.broadcast(self.fields.select("field_idx", "total", "dim")), "field_idx")
        return cut(rows.withColumn("weight", F.log(F.col("total") / F.col("cnt"))).select("field_idx", "term", "cnt", "term_idx", "total", "dim", "weight"))

    def fingerprint(self) -> DataFrame:
        """(field_idx, fingerprint): equal for equal counts, whatever their order."""
        h = F.conv(F.substring(F.md5(F.concat_ws(":", "term", F.col("cnt").cast("string")).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
        sums = self.counts.groupBy("field_idx").agg(F.count("*").alias("n"), F.sum(h).cast("decimal(38,0)").alias("s"))
        return sums.select("field_idx", F.md5(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")).cast("binary")).alias("fingerprint"))

    def save(self, path: str) -> None:
        """Counts as Parquet, the definition as a line of text beside them."""
        spark = self.counts.sparkSession
        self.counts.write.mode("overwrite").parquet(str(PurePosixPath(path) / "counts") if "://" not in path else f"{path}/counts")
        spark.createDataFrame([(json.dumps(json.loads(self.schema.to_json())),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        text = "".join(r.value for r in spark.read.text(f"{path}/schema").collect())
        return cls(SchemaDef.from_json(text), spark.read.parquet(f"{path}/counts"))


def learn(records: DataFrame, schema: SchemaDef, id_col: str = "id") -> Vocabulary:
    """Count the terms of all fields in one pass over the records. A term counts once for each
    occurrence; empty terms never count. The counts, which are as many as there are terms, are
    kept: nothing that is derived from them reads the records again."""
    terms = field_terms(records, schema, id_col).where("term <> ''")
    return Vocabulary(schema, cut(terms.groupBy("field_idx", "term").agg(F.count("*").alias("cnt"))))
