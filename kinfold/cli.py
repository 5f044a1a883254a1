"""Commands: learn a schema, index files, query an index, keep random components.

    python -m kinfold.cli learn --schema def.json --source source.json --in 'data/*.csv' --out learnt
    python -m kinfold.cli index --schema learnt --source source.json --in 'data/*.csv' --index idx
    python -m kinfold.cli query --schema learnt --source source.json --in 'probes.csv' --index idx
    python -m kinfold.cli hash --count 1000000 --out components
"""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession

from kinfold.functions import gauss
from kinfold.operators.index import Index
from kinfold.operators.lineage import cut
from kinfold.operators.signature import sign
from kinfold.operators.vocabulary import Vocabulary, learn
from kinfold.plans.definitions import SchemaDef, SourceDef
from kinfold.sources import delimited


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinfold")
    commands = top.add_subparsers(dest="command", required=True)
    for name, options in {"learn": ("schema", "source", "in", "out"), "index": ("schema", "source", "in", "index"), "query": ("schema", "source", "in", "index")}.items():
        c = commands.add_parser(name)
        for o in options:
            c.add_argument(f"--{o}", required=True, dest="files" if o == "in" else o)
        if name != "learn":
            c.add_argument("--mode", choices=("set", "multiset"), default="set")
            c.add_argument("--oov", choices=("reference", "ignore"), default="reference")
        if name == "query":
            c.add_argument("--limit", type=int)
            c.add_argument("--min-matches", type=int, default=1)
    c = commands.add_parser("hash")
    c.add_argument("--count", type=int, required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--seed", default=gauss.SEED)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("kinfold").getOrCreate()
    if a.command == "hash":
        gauss.components(spark, a.count, a.seed).write.mode("overwrite").parquet(a.out)
        return 0
    records = delimited.read(spark, SourceDef.from_json(Path(a.source).read_text()), a.files)
    if a.command == "learn":
        learn(records, SchemaDef.from_json(Path(a.schema).read_text())).save(a.out)
        return 0
    vocabulary = Vocabulary.load(spark, a.schema)
    signed = cut(sign(records, vocabulary, oov=a.oov))
    index = Index(spark, a.index, a.mode)
    if a.command == "index":
        index.write(records, signed, time.time_ns())
    else:
        index.query(signed, limit=a.limit, min_matches=a.min_matches).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
