"""Removal of lines that spread over many sites, in DataFrame functions only.

Every line becomes two 64-bit hashes. Partial aggregation merges one small HyperLogLog sketch
of sites per hash before and after the shuffle, so a line that is everywhere costs one row per
task. A sketch's estimate settles lines that are clearly below or above the threshold; lines
within the sketch's error of it get an exact count of distinct sites. Of a line that spreads,
the occurrence in the smallest document stays; all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

#: Distinct sites from which a line counts as boilerplate.
SITES = 10
#: Log2 of a sketch's registers, and the share of a count within which an estimate may err:
#: four standard errors of 1.04 / sqrt(registers).
REGISTERS_LOG2 = 8
ERROR = 0.26


def _keyed(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """The three columns under fixed names and two hashes that tell rows apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(site_col).alias("site"))
    return rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id")})


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line that is not empty: the document's keys, site, position, hashes."""
    at = rows.select("doc_id", "k1", "k2", F.xxhash64("site").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    return at.select("doc_id", "k1", "k2", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def spread(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2, keeper) of the lines at ``sites`` or more distinct sites; keeper is the smallest
    id of a document that has the line."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", REGISTERS_LOG2).alias("sketch"), F.min("doc_id").alias("keeper"))
    rough = sketched.select("h1", "h2", "keeper", F.hll_sketch_estimate("sketch").alias("about")).where(F.col("about") >= sites * (1 - ERROR))
    rough = cut(rough)
    sure, near = rough.where(F.col("about") > sites * (1 + ERROR)), rough.where(F.col("about") <= sites * (1 + ERROR))
    asked = small(near.select("h1", "h2", "keeper"), near.count())
    pairs = lines.join(asked, ["h1", "h2"]).groupBy("h1", "h2", "keeper", "site").agg(F.lit(1))
    exact = pairs.groupBy("h1", "h2", "keeper").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return cut(sure.select("h1", "h2", "keeper").unionByName(exact.select("h1", "h2", "keeper")))


def dropped(rows: DataFrame, sites: int = SITES) -> DataFrame:
    """(k1, k2, drop): the positions of the lines to remove, for rows that have such lines."""
    lines = _lines(rows)
    common = spread(lines, sites)
    hits = lines.join(small(common, common.count()), ["h1", "h2"])
    # of the keeper's occurrences the first stays
    per = hits.groupBy("k1", "k2", "h1", "h2").agg(F.collect_set("pos").alias("at"), F.first("doc_id", True).alias("doc_id"), F.first("keeper", True).alias("keeper"))
    gone = F.when(F.col("doc_id") == F.col("keeper"), F.slice(F.array_sort("at"), 2, F.size("at"))).otherwise(F.col("at"))
    return per.select("k1", "k2", gone.alias("at")).where(F.size("at") > 0).groupBy("k1", "k2").agg(F.flatten(F.collect_list("at")).alias("drop"))


def _kept(text: Column, drop: Column) -> Column:
    """``text`` without the lines at the positions ``drop``, in time linear in both."""

    def left(lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(at, lambda k: F.get(lines, k)), "\n")

    return F.when(drop.isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n")), left)[0])


def dedup_lines(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Each document's text without lines that stand at ``sites`` or more distinct sites.

    Returns ``id_col``, n_lines, n_removed, text (the kept lines, in order). Lines end with a
    line feed and compare byte by byte; an empty line never counts. Of a spreading line the
    first occurrence in the document with the smallest id stays. A null text is empty, a null
    site is one site, a null id never is the smallest; repeated rows are decided alike; an
    empty table gives an empty result.
    """
    rows = _keyed(docs, id_col, text_col, site_col)
    rows = rows.join(dropped(rows, sites).hint("shuffle_hash"), ["k1", "k2"], "left")
    removed = F.coalesce(F.size("drop"), F.lit(0))
    return rows.select(
        F.col("doc_id").alias(id_col),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(removed).cast("bigint").alias("n_removed"),
        _kept(F.col("text"), F.col("drop")).alias("text"),
    )


def rewrite(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs``, all rows and columns, with the texts that :func:`dedup_lines` gives; a text that
    loses nothing stays as it is, null included. ``chars_col``, if there is one, is set to a
    changed text's length."""
    keys = _keyed(docs, id_col, text_col, site_col)
    whole = docs.select(F.struct("*").alias("row")).withColumns({"id": F.col(f"row.{id_col}"), "text": F.coalesce(F.col(f"row.{text_col}"), F.lit(""))})
    whole = whole.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(1), "text", "id")}).drop("id", "text")
    joined = whole.join(dropped(keys, sites).hint("shuffle_hash"), ["k1", "k2"], "left")
    text = _kept(F.col(f"row.{text_col}"), F.col("drop"))
    new = {text_col: text} | ({chars_col: F.when(F.col("drop").isNull(), F.col(f"row.{chars_col}")).otherwise(F.char_length(text)).cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    return joined.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_lines, n_removed, n_chars and kept_sha256 of what stays."""
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as text, source from documents),
l as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from d
),
b as (
  select line, min(doc_id) as keeper from l where line <> '' group by line
  having count(distinct source) + max(case when source is null then 1 else 0 end) >= {SITES}
),
m as (
  select l.doc_id, l.line, l.pos,
    b.line is not null and not (l.doc_id = b.keeper and row_number() over (partition by l.doc_id, l.line order by l.pos) = 1) as gone
  from l left join b on l.line = b.line
),
k as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
    coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept
  from m group by doc_id
)
select doc_id, n_lines, n_removed, length(kept)::bigint as n_chars, sha256(kept) as kept_sha256 from k
"""
