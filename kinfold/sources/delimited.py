"""Delimited files as records: an id and named string attributes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinfold.plans.definitions import SourceDef


def parsed_id(text: Column) -> Column:
    """An unsigned 32-bit number; blanks, signs and anything else raise."""
    value = F.when(text.rlike("^[0-9]+$"), F.try_to_number(F.right(F.concat(F.lit("0" * 20), F.ltrim(text, F.lit("0"))), F.lit(20)), F.lit("9" * 20)).cast("decimal(20,0)"))
    return F.when(value <= 4294967295, value.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not an id: "), F.coalesce(text, F.lit("")))))


def _options(reader, source: SourceDef, multi_line: bool):
    # all columns are parsed, so that a row of another length is found whatever is selected
    options = {"header": "false", "sep": source.delimiter, "quote": '"', "escape": '"', "multiLine": str(multi_line).lower(), "mode": "FAILFAST", "columnPruning": "false", "inferSchema": "false"}
    return reader.options(**options)


def project(rows: DataFrame, source: SourceDef) -> DataFrame:
    """Raw columns to id and attributes; empty cells are '', never null."""
    names = rows.columns
    need = max([source.id_column, *source.columns.values()])
    if need > len(names):
        raise ValueError(f"column {need} is asked for, the files have {len(names)}")
    cells = [F.coalesce(F.col(names[n - 1]), F.lit("")).alias(a) for a, n in source.columns.items()]
    return rows.select(parsed_id(F.col(names[source.id_column - 1])).alias("id"), *cells)


def one_line_rows(spark: SparkSession, source: SourceDef, glob: str | None = None) -> bool:
    """Whether every line of the files is a whole row: none has a quote that does not belong to a
    quoted cell, none a carriage return but at its end. The search stops at the first other line."""
    mark = rf"\Q{source.delimiter}\E"
    quoted = rf'(?:^|(?<={mark}))"[^"]*+(?:""[^"]*+)*+"(?={mark}|\r?\z)'
    line = F.col("value")
    odd = F.regexp_replace(line, quoted, "").contains('"') | line.rlike(r"\r[\s\S]") | ((line != "") & ~line.rlike(r"[^\x00-\x20]"))
    return spark.read.option("lineSep", "\n").text(glob or source.glob).where(odd).isEmpty()


def read(spark: SparkSession, source: SourceDef, glob: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """All records of the files that ``glob`` (or the definition's) names.

    Blank lines are skipped; a row of another length or an id that is no unsigned 32-bit number
    stops the read. Quoted cells may hold line ends; a file that is read with ``multi_line`` is
    read by one task. Without it files are split, which is right if every line is a whole row.
    Which of them holds is found by a pass over the lines unless it is given.
    """
    if multi_line is None:
        multi_line = not one_line_rows(spark, source, glob)
    return project(_options(spark.read, source, multi_line).csv(glob or source.glob), source)


def _width(spark: SparkSession, source: SourceDef, glob: str | None) -> int:
    named = max([source.id_column, *source.columns.values()])
    try:
        return max(named, len(_options(spark.read, source, True).csv(glob or source.glob).columns))
    except AnalysisException:  # no file is there, or none has a row
        return named


def read_stream(spark: SparkSession, source: SourceDef, glob: str | None = None, width: int | None = None, multi_line: bool = True) -> DataFrame:
    """The same as a stream of files, ``concurrent`` of them at a time if that is set. Lines of
    files that are still to come cannot be looked at, so cells may hold line ends unless told.

    All rows have ``width`` columns; if that is not given, as many as the files that are there
    when the stream starts, or as the definition names if there are none yet."""
    count = width or _width(spark, source, glob)
    schema = StructType.fromDDL(", ".join(f"_c{k} string" for k in range(count)))
    reader = _options(spark.readStream, source, multi_line).schema(schema)
    if source.concurrent:
        reader = reader.option("maxFilesPerTrigger", source.concurrent)
    return project(reader.csv(glob or source.glob), source)
