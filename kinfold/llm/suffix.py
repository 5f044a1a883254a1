"""Exact removal of repeated 200-byte strings by blockwise suffix sorting.

A window is a string of 200 bytes; its anchor is the least hash among its 48-byte strings, so
equal windows have equal anchors at equal places. Windows next to each other mostly share an
anchor, and such a run of windows is one row: the anchor, a hash of the run's bytes, its place.
Equal runs of a task, compared byte by byte, are one row from there on. Runs whose anchor stands
elsewhere, too, go on with their bytes.

All suffixes that begin the runs of one anchor form a bucket. Buckets are sorted block by block.
A sample of positions, a difference cover modulo 64, is ranked beforehand by 192 bytes: the
first 64 by sorting words, the rest by the ranks of the sample positions 64 and 128 further.
Any suffix meets the sample within 8 bytes, so it is ordered by its first word, the rank of the
sample position it meets and its last word; long ties cost no more than short ones. Neighbours
that agree are equal windows.

A bucket of very many runs is first split: the windows that begin 0 to 18 bytes before the
anchor, 19 to 37, and so on, are parts of their own, and of a part only runs that agree in the
bytes all its windows cover can hold equal windows. Parts that are still too large are split
into narrower ones, down to single windows. Runs of a part that are equal within a task become
one row again, so a passage that is everywhere ends in as many rows as there are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, counted, cut, released, saved, ship, small

#: Bytes of a string that counts as repeated.
LENGTH = 200
GRAM = 48
WIDE = LENGTH - GRAM + 1
#: Bytes hashed together, and the bits that a place among them takes.
CHUNK = 1 << 18
PLACE_BITS = 22
#: Bytes of runs in a block that is sorted at once.
BLOCK = 500_000
#: Bytes of texts or runs that a task turns into Python objects at once, and rows.
HELD, ROWS = 2_000_000, 500
#: Runs of a bucket beyond which it is split, and the widths in windows of the parts.
CROWD = 4_000
WIDTHS = (19, 4, 1)
COVER_MOD = 64
#: The difference cover: every difference modulo 64 is one of a multiple of 8 and a number below 8.
COVER = sorted({*range(8), *range(0, COVER_MOD, 8)})
_TO_COVER = np.array([next(k for k in range(COVER_MOD) if (r + k) % COVER_MOD in COVER) for r in range(COVER_MOD)])

_BASE = 0x5851F42D4C957F2D
_BYTES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> list[np.ndarray]:
    """The base's powers and its inverse's, modulo 2^64, for n places at least."""
    while len(_powers[0]) < n:
        size = len(_powers[0])
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, size, 1 << 64))])
    return _powers


def _least(key: np.ndarray, wide: int) -> np.ndarray:
    """The least of every ``wide`` neighbours: of two blocks, one's end and the next's start."""
    n = len(key) - wide + 1
    padded = np.full(-(-len(key) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, wide)
    start = np.minimum.accumulate(rows, axis=1).ravel()
    end = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(end[:n], start[wide - 1 : wide - 1 + n])


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, anchor, digest, first, count, offset) of every run of windows of some texts; each
    text has LENGTH bytes at least, all together less than 2^PLACE_BITS. The anchor stands
    ``offset`` bytes after the first of ``count`` windows."""
    b = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    power, inverse = (p[: len(b) + 1] for p in _power(len(b) + 1))
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[b] * power[:-1])))
    gram = _mix((total[GRAM:] - total[:-GRAM]) * inverse[: len(b) - GRAM + 1])
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = _least((gram & ~mask) | np.arange(len(gram), dtype=np.uint64), WIDE)
    place = (least & mask).astype(np.int64)
    edge = np.zeros(len(b) + 1, np.int8)
    edge[begin] = 1
    np.add.at(edge, begin + sizes - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[: len(place)]))
    at = place[window]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    first = window[new]
    count = np.diff(np.append(new, len(window)))
    at = at[new]
    offset = at - first
    body = (total[first + count - 1 + LENGTH] - total[first]) * inverse[first]
    digest = _mix(_mix(body) ^ (count << 8 | offset).astype(np.uint64))
    text = np.searchsorted(begin, first, side="right") - 1
    return text, gram[at], digest, first - begin[text], count, offset


def _pieces(key: int, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(key, start, bytes) of a text in pieces of at most CHUNK windows."""
    for start in range(0, len(raw) - LENGTH + 1, CHUNK):
        yield key, start, raw[start : start + CHUNK + LENGTH - 1]


def _all_runs(keys: list[int], texts: list[bytes]) -> list[np.ndarray]:
    """key, anchor, digest, first, count, offset of the texts' runs, in chunks of CHUNK bytes."""
    out, held, size = [], [], 0

    def emit() -> None:
        text, anchor, digest, first, count, offset = runs([p[2] for p in held])
        key = np.array([p[0] for p in held], np.int64)[text]
        out.append((key, anchor.view(np.int64), digest.view(np.int64), first + np.array([p[1] for p in held], np.int64)[text], count, offset))

    for key, raw in zip(keys, texts, strict=True):
        for piece in _pieces(key, raw):
            if held and size + len(piece[2]) > CHUNK:
                emit()
                held, size = [], 0
            held.append(piece)
            size += len(piece[2])
    if held:
        emit()
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6


#: Rows between the stages. kind 0: a run that its task saw once; 1: one row for equal runs that a
#: task saw more often; 2: windows ``at`` to ``digest`` of a text, found to be repeats.
_ROW = {"anchor": pa.int64(), "digest": pa.int64(), "key": pa.int64(), "at": pa.int64(), "kind": pa.int8()}
_ROW_SQL = "anchor bigint, digest bigint, key bigint, at bigint, kind tinyint"


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), t) for c, t in zip(columns, _ROW.values(), strict=True)], list(_ROW))


def _joined(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows, those that touch or overlap made one."""
    if not len(key):
        return key, first, last
    order = np.lexsort((first, key))
    key, first, last = key[order], first[order], last[order]
    part = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))) << 40  # keeps keys apart
    reach = np.maximum.accumulate(last + part)
    new = np.ones(len(key), bool)
    new[1:] = (first + part)[1:] > reach[:-1] + 1
    head = np.flatnonzero(new)
    ends = np.append(head[1:], len(key)) - 1
    return key[head], first[head], reach[ends] & ((1 << 40) - 1)


def _ranges(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    key, first, last = _joined(key, first, last)
    return _rows(key, last, key, first, np.full(len(key), 2, np.int8))


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group of equal neighbours, first row of each group)."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (key, text) to rows: the runs, those seen once and those seen more often."""
    for batch in batches:
        keys, texts = batch.column(0).to_numpy(), batch.column(1)
        found, k = [], 0
        for part in _slices(batch, 1):
            raw = [(k + n, t.encode()) for n, t in enumerate(part.column(1).to_pylist())]
            raw = [(n, t) for n, t in raw if len(t) >= LENGTH]
            found.append(_all_runs([n for n, _ in raw], [t for _, t in raw]))
            k += part.num_rows
        if not found:
            continue
        row, anchor, digest, first, count, offset = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((digest, anchor))
        row, anchor, digest, first, count, offset = (c[order] for c in (row, anchor, digest, first, count, offset))
        group, head = _groups(anchor, digest)
        same = _verified(texts, row, first, count, group, head)
        many = np.bincount(group, same, minlength=len(head)) > 1
        at, key = first << 16 | count << 8 | offset, keys[row]
        kind = np.where(many, 1, 0).astype(np.int8)
        yield _rows(anchor[head], digest[head], key[head], at[head], kind)
        if not same.all():  # equal hashes of other bytes
            odd = ~same
            yield _rows(anchor[odd], digest[odd], key[odd], at[odd], np.zeros(odd.sum(), np.int8))
        if many.any():
            own = many[group] & same
            yield _ranges(key[own], first[own], first[own] + count[own] - 1)


def _verified(texts: pa.Array, row: np.ndarray, first: np.ndarray, count: np.ndarray, group: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether each run has the bytes of its group's first one."""
    same = np.ones(len(row), bool)
    same[head] = False
    asked = np.flatnonzero(same)
    same[:] = True
    if not len(asked):
        return same
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset :]
    data = memoryview(texts.buffers()[2])
    begin, size = offsets[row] + first, count + LENGTH - 1
    of = head[group[asked]]
    for k, a, b, n, m in zip(asked.tolist(), begin[asked].tolist(), begin[of].tolist(), size[asked].tolist(), size[of].tolist(), strict=True):
        same[k] = n == m and data[a : a + n] == data[b : b + n]
    return same


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: those whose anchor has another row."""

    def settle(cols: list[np.ndarray]) -> pa.RecordBatch:
        bucket, _ = _groups(cols[0])
        shared = (np.bincount(bucket) > 1)[bucket]
        return _rows(*(c[shared] for c in cols))

    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= 100_000:
            cols = [np.concatenate(c) for c in zip(*held)]
            last = np.searchsorted(cols[0], cols[0][-1])
            if last:
                yield settle([c[:last] for c in cols])
            held = [[c[last:] for c in cols]]
            size = len(held[0][0])
    if held:
        yield settle([np.concatenate(c) for c in zip(*held)])


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ROWS rows and about HELD bytes of a text or binary column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD))
        n = min(max(1, fits - at), ROWS)
        yield batch.slice(at, n)
        at += n


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(packed piece, asked, start) to (anchor, key, at, kind, body): the bytes of the runs asked for."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        packed, asked, start = batch.columns
        parts, bodies, size = [], [], 0

        def made() -> pa.RecordBatch:
            rows = pa.concat_arrays(parts)
            return pa.RecordBatch.from_arrays([*(rows.field(k) for k in ("anchor", "key", "at", "kind")), pa.array(bodies, pa.binary())], list(_BODY))

        for k in range(batch.num_rows):
            raw, own = open_.decompress(packed[k].as_py()), asked[k].values
            at = own.field("at").to_numpy()
            first = (at >> 16) - start[k].as_py()
            end = first + (at >> 8 & 255) + LENGTH - 1
            bodies += [raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
            parts.append(own)
            size += int((end - first).sum())
            if size > HELD:
                yield made()
                parts, bodies, size = [], [], 0
        if parts:
            yield made()


_BODY = {"anchor": pa.int64(), "key": pa.int64(), "at": pa.int64(), "kind": pa.int8(), "body": pa.binary()}
_BODY_SQL = "anchor bigint, key bigint, at bigint, kind tinyint, body binary"


def split(rows: list[tuple], width: int) -> list[tuple]:
    """Runs (bucket, key, at, kind, body) of too large buckets, cut into parts of ``width``
    distances from the anchor, each in a bucket of runs that agree where all its windows do.
    Equal parts become one of kind 1; ranges that this proves to be repeats have kind 2, the
    last window as bucket and the first as place."""
    seen: dict[tuple, list] = {}
    out = []
    for bucket, key, at, kind, body in rows:
        first, count, offset = at >> 16, at >> 8 & 255, at & 255
        window = 0
        while window < count:
            part = (offset - window) // width  # distances part * width up to the next part's
            n = min(count - window, offset - window - part * width + 1)
            own = body[window : window + n + LENGTH - 1]
            near, far = part * width, part * width + width - 1
            place = offset - window  # the anchor in ``own``
            core = own[max(0, place - near) : place - far + LENGTH]
            named = xxhash.xxh64_intdigest(core, seed=xxhash.xxh64_intdigest(f"{bucket} {width} {part}")) - (1 << 63)
            same = (named, place, own)
            if same in seen:
                head = seen[same]
                if head[3] == 0:
                    out.append((head[1] + head[2] - 1, head[0], head[1], 2, None))
                    head[3] = 1
                if kind == 0:
                    out.append((first + window + n - 1, key, first + window, 2, None))
            else:
                seen[same] = [key, first + window, n, kind]
            window += n
    return out + [(named, key, first << 16 | n << 8 | place, kind, own) for (named, place, own), (key, first, n, kind) in seen.items()]


def _split(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2_000):
                batch = whole.slice(k, 2_000)
                made = list(zip(*split(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), width)))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, _BODY.values(), strict=True)], list(_BODY))

    return run


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, ordered as the bytes are."""
    wide = np.lib.stride_tricks.sliding_window_view(t, 8)
    return np.ascontiguousarray(wide).view(">u8").ravel().astype(np.uint64)


def _ranked(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by their columns, the first counting most."""
    order = np.lexsort(columns[::-1])
    group, _ = _groups(*(c[order] for c in columns))
    out = np.empty(len(order), np.int64)
    out[order] = group
    return out


def sort_block(anchor: np.ndarray, offset: np.ndarray, count: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, window, class) of the suffixes of a block that equal another of their bucket.

    Every body is laid so that its anchor is at a multiple of COVER_MOD; suffixes that begin
    equally far from their anchors then meet the cover equally soon.
    """
    lead = -offset % COVER_MOD
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    room = -(-(lead + sizes) // COVER_MOD) * COVER_MOD
    begin = np.cumsum(room) - room + lead
    text = np.zeros(int(room.sum()) + COVER_MOD, np.uint8)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[np.repeat(begin, sizes) + inner] = np.frombuffer(b"".join(bodies), np.uint8)
    word = _words(text)
    run = np.repeat(np.arange(len(bodies)), count)
    window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = begin[run] + window
    meets = at + _TO_COVER[at % COVER_MOD]
    needed = np.zeros(len(text), bool)
    for step in (0, 64, 128):
        needed[meets + step] = True
    sample = np.flatnonzero(needed)
    rank = np.zeros(len(text), np.int64)
    rank[sample] = _ranked(*(word[sample + 8 * k] for k in range(8)))  # 64 bytes
    start = np.zeros(len(text), bool)
    start[meets] = True
    start = np.flatnonzero(start)
    long = np.zeros(len(text), np.int64)
    long[start] = _ranked(rank[start], rank[start + 64], rank[start + 128])  # 192 bytes
    bucket = _ranked(anchor)[run] * (2 * LENGTH) + (window - offset[run] + LENGTH)
    keys = bucket, word[at], long[meets], word[at + LENGTH - 8]
    order = np.lexsort(keys[::-1])
    group, _ = _groups(*(k[order] for k in keys))
    tied = np.bincount(group)[group] > 1
    order, group = order[tied], group[tied]
    return run[order], window[order], group


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor, a block of whole buckets at a time, to ranges of repeats."""

    def settle(anchor: np.ndarray, key: np.ndarray, at: np.ndarray, kind: np.ndarray, bodies: list[bytes]) -> pa.RecordBatch:
        first, count, offset = at >> 16, at >> 8 & 255, at & 255
        run, window, _ = sort_block(anchor, offset, count, bodies)
        once = kind[run] == 0
        run, window = run[once], window[once]
        place = first[run] + window
        return _ranges(key[run], place, place)

    held: list[tuple] = []
    bodies: list[bytes] = []
    size = 0
    for batch in (part for whole in batches for part in _slices(whole, 4)):
        held.append(tuple(batch.column(k).to_numpy() for k in range(4)))
        bodies += batch.column(4).to_pylist()
        size += sum(map(len, bodies[-batch.num_rows :]))
        if size >= BLOCK:
            cols = [np.concatenate(c) for c in zip(*held)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield settle(*(c[:last] for c in cols), bodies[:last])
            held, bodies = [tuple(c[last:] for c in cols)], bodies[last:]
            size = sum(map(len, bodies))
    if bodies:
        yield settle(*(np.concatenate(c) for c in zip(*held)), bodies)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with the text compressed, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in _slices(whole, 2):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([tight.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "key", "packed"])

    return rows.select("doc_id", "key", "text").mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key bigint, packed binary")


def _pieced(rows: DataFrame) -> DataFrame:
    """(key, piece, packed): the texts' pieces, compressed for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in _slices(whole, 1):
                made = [(key, start // CHUNK, tight.compress(raw)) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for key, start, raw in _pieces(n, t.encode())]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "piece", "packed"])

    return rows.select("key", "text").mapInArrow(released(run), "key bigint, piece bigint, packed binary")


def _bodies(rows: DataFrame, runs_: DataFrame) -> DataFrame:
    """(anchor, key, at, kind, body): runs with their bytes, from the texts of ``rows``. Texts go
    by pieces, so neither a text nor what is asked of it need fit one row."""
    piece = F.shiftright("at", 16 + CHUNK.bit_length() - 1).alias("piece")
    asked = runs_.groupBy("key", piece).agg(F.collect_list(F.struct("anchor", "key", "at", "kind")).alias("asked"))
    texts, few = counted(runs_.select("key").distinct())
    wanted = rows.join(F.broadcast(texts), "key", "left_semi") if few <= BROADCAST_ROWS else rows
    packed = _pieced(wanted).dropDuplicates(["key", "piece"]).join(asked, ["key", "piece"]).select("packed", "asked", (F.col("piece") * CHUNK).alias("start"))
    return packed.mapInArrow(released(_cut_out), _BODY_SQL)


def _ranges_of(found: DataFrame) -> DataFrame:
    """The ranges among rows of either form, as (key, span)."""
    last = "anchor" if "body" in found.columns else "digest"
    return found.where("kind = 2").select("key", F.struct(F.col("at").alias("first"), F.col(last).alias("last")).alias("span"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(key, spans): per text with repeats the windows, as array of first and last, that equal a
    window elsewhere. A text's key is a hash of its id and text. ``crowd`` (:data:`CROWD`) only
    decides how the work is parted."""
    rows = _keyed(docs, id_col, text_col)
    scanned = saved(rows.select("key", "text").mapInArrow(released(_scan), _ROW_SQL))
    single = scanned.where("kind < 2")

    def parted(buckets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows of buckets of at most ``crowd`` rows, and those of the others, if any."""
        large, many = counted(buckets.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"))
        if not many:
            return buckets, None
        large = small(large, many)
        return buckets.join(large, "anchor", "left_anti"), buckets.join(large, "anchor", "left_semi")

    def sorted_(bodies: DataFrame) -> DataFrame:
        return bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(released(_sort), _ROW_SQL)

    calm, hot = parted(single)
    shared = cut(calm.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(released(_shared), _ROW_SQL))
    found = [scanned, sorted_(_bodies(rows, shared))]
    hot = saved(_bodies(rows, hot)) if hot is not None else None
    for width in WIDTHS if hot is not None else ():
        parts = saved(hot.mapInArrow(released(_split(width)), _BODY_SQL))
        found.append(parts)
        calm, hot = parted(parts.where("kind < 2")) if width > 1 else (parts.where("kind < 2"), None)
        found.append(sorted_(calm))
        if hot is None:
            break
    spans = _ranges_of(found[0])
    for more in found[1:]:
        spans = spans.unionByName(_ranges_of(more))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Each text without the bytes that a repeated 200-byte string covers.

    Returns ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, the
    bytes left, joined). A string repeats if it also starts anywhere else, in the same text or
    another; overlaps count, and no string crosses texts. A null text is empty; repeated rows
    are texts of their own, and so repeats; null ids are allowed; an empty table gives an empty
    result.
    """
    rows = _keyed(docs, id_col, text_col)
    joined = _packed(rows).join(repeats(docs, id_col, text_col, crowd), "key", "left").select("doc_id", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in _slices(whole, 1):
                out = []
                for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw = open_.decompress(packed)
                    kept, at, n = [], 0, 0
                    for s in spans or ():
                        first, end = s["first"], s["last"] + LENGTH
                        if first > at or not n:  # a new run, unless it touches the last one
                            n += 1
                            kept.append(raw[at:first])
                        at = max(at, end)
                    kept.append(raw[at:])
                    left = b"".join(kept)
                    out.append((len(raw), len(raw) - len(left), n, left))
                made = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["key", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(released(run), f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("key", id_col)


def digests(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The query's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
