"""Document quality: histogram gradient-boosted trees over statistics of a text.

The statistics come from the text alone. Trees grow on binned features from gradient
histograms (logistic loss); the fitted trees lie in flat arrays, and scoring walks all trees
for all rows of a batch together in numpy. Only a bounded, hashed sample of labelled rows is
gathered for fitting; scoring covers every row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, ship

#: Most labelled rows that a fit gathers.
LABELLED_ROWS = 12_000
#: A document is good if its score is at least this.
THRESHOLD = 0.3

#: Classes of UTF-8 bytes: letters, capitals, digits, blanks, line ends, each kind of mark, rest.
_CLASS = np.full(256, 7, np.int64)
_CLASS[[*range(0x61, 0x7B)]] = 0
_CLASS[[*range(0x41, 0x5B)]] = 1
_CLASS[[*range(0x30, 0x3A)]] = 2
_CLASS[[0x20, 0x09, 0x0D]] = 3
_CLASS[0x0A] = 4
_CLASS[[*b".,;:'\"-?()"]] = 5
_CLASS[[*b"!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_MARKS = [*b"!|#$%&*<>{}=_/.,"]
_CAPS = re.compile(r"[^\W\d_]+")

FEATURES = [
    "bytes", "words", "lines", "word_length", "longest_word", "distinct_words", "top_word", "distinct_lines", "line_length", "top_line",
    "capitals", "digits", "blanks", "plain_marks", "odd_marks", "high_bytes", "short_words", "long_words", "all_caps", "odd_word_ends",
    "sentence_ends", "packed", "distinct_pairs", *(f"mark_{chr(m)}" for m in _MARKS),
]


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES; an empty text gives zeros."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_CLASS, weights=byte, minlength=8) / len(raw)
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = text.split("\n")
    held: dict[str, int] = {}
    for x in lines:
        held[x] = held.get(x, 0) + len(x)
    pairs = len(set(zip(words, words[1:])))
    caps = sum(len(w) > 1 and w.isupper() for w in words)
    odd = sum(w[-1] in "!#$%&*|" for w in words)
    ends = sum(w[-1] in ".?" for w in words)
    packed = len(zlib.compress(raw, 1)) / len(raw)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.max(), len(seen) / n, max(seen.values(), default=0) / n,
        len(held) / len(lines), np.log1p(len(text) / len(lines)), max(held.values()) / max(1, len(text)), kind[1], kind[2], kind[3], kind[5], kind[6], kind[7],
        (lengths <= 2).mean(), (lengths >= 12).mean(), caps / n, odd / n, ends / n, packed, pairs / max(1, len(words) - 1), *(byte[m] / len(raw) for m in _MARKS),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    limit: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document for each row of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.limit[at], self.low[at], self.high[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 0.5) -> Trees:
    """Boost ``trees`` trees of ``depth`` levels. Without rows every score is 0.5; with one
    class, the class's smoothed share."""
    good = (float(y.sum()) + 1) / (len(y) + 2)
    base = float(np.log(good / (1 - good)))
    limits = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
    binned = np.column_stack([np.searchsorted(m, c, side="left") for m, c in zip(limits, x.T, strict=True)]) if len(x) else np.zeros((0, x.shape[1]), np.int64)
    wide = x.shape[1]
    flat = binned + np.arange(wide) * bins
    nodes: list[list] = []  # feature, limit, low, high, value
    roots, margin = [], np.full(len(y), base)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, 0, 0.0])
        level = [(len(nodes) - 1, np.arange(len(y)))]
        for step in range(depth + 1):
            below = []
            for number, rows in level:
                g, h = slope[rows].sum(), bend[rows].sum()
                split = None
                if step < depth and h > 2 * least:
                    cells = flat[rows].ravel()
                    gs = np.bincount(cells, np.repeat(slope[rows], wide), wide * bins).reshape(wide, bins).cumsum(1)
                    hs = np.bincount(cells, np.repeat(bend[rows], wide), wide * bins).reshape(wide, bins).cumsum(1)
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g * g / (h + ridge)
                    gain[(hs < least) | (h - hs < least)] = 0
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(limits[f]):
                        split = int(f), int(b)
                if split is None:
                    value = -rate * g / (h + ridge)
                    nodes[number] = [0, 0.0, number, number, value]
                    margin[rows] += value
                    continue
                f, b = split
                left = binned[rows, f] <= b
                for part in (rows[left], rows[~left]):
                    nodes.append([0, 0.0, 0, 0, 0.0])
                    below.append((len(nodes) - 1, part))
                nodes[number] = [f, float(limits[f][b]), len(nodes) - 2, len(nodes) - 1, 0.0]
            level = below
    made = list(zip(*nodes)) if nodes else [[0], [0.0], [0], [0], [0.0]]
    return Trees(*(np.array(c, t) for c, t in zip(made, (np.int64, np.float64, np.int64, np.int64, np.float64))), np.array(roots, np.int64), base, depth)


def held_out(id_col: str):
    """Rows that fitting never sees: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = LABELLED_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents, those whose ids hash lowest.

    Rows with a null id or a label other than 0 and 1 are left out; of several labels of an id
    the largest counts, of several rows of an id the one with the least statistics. The sampled
    ids (at most ``rows``) are broadcast to the scan of the texts, the statistics are computed
    there, and only their numbers, one row an id, come to the driver.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(known), "key").select("key", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                values = matrix(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(values), pa.list_(pa.float64()))], ["key", "label", "x"])

    kind = sample.schema["key"].dataType.simpleString()
    found = sample.mapInArrow(run, f"key {kind}, label double, x array<double>")
    got = found.groupBy("key").agg(F.min(F.struct("label", "x")).alias("r")).select("key", "r.label", "r.x").toArrow().sort_by("key")
    x = np.array(got["x"].to_pylist(), np.float64).reshape(got.num_rows, len(FEATURES))
    return fit(x, got["label"].to_numpy().astype(np.float64))


def _scored(model: Trees, rows: DataFrame, keep: float | None, text_at: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                score = model.score(matrix(batch.column(text_at).to_pylist()))
                if keep is not None:
                    yield batch.filter(pa.array(score >= keep))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["key", "score"])

    ship(rows.sparkSession)
    return rows.mapInArrow(released(run), schema)


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD) for every row.

    A null text counts as empty; repeated rows and null ids keep their rows (a null id is not
    held out); an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = _scored(model, rows, None, 1, f"key {rows.schema['key'].dataType.simpleString()}, score double")
    out = out.withColumnRenamed("key", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least THRESHOLD. A null text counts
    as empty; repeated rows and null ids are judged by their text like any other; an empty table
    gives an empty result."""
    return _scored(model, docs, THRESHOLD, docs.columns.index(text_col), docs.schema)
