"""Interleaved sequences of text and media: HTML to ordered parts, payloads by digest.

A page becomes an array of parts in document order: texts, and references to media with their
captions. Media lie in a store keyed by the digest of their payload; a join on the digest
resolves references, whatever their number, and keeps position and caption beside the payload.
Only references go through the join; texts stay with their page until the sequence is put
together. The stored form is an 8-bit greyscale PNG of 64 samples a row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, ship

#: Samples in a row of a stored image.
WIDE = 64
SCHEME = "sha256:"
PARTS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"

_MEDIA = {"img": "image", "audio": "audio", "video": "video", "embed": "document", "object": "document", "source": "source"}
_HIDDEN = {"script", "style", "template", "noscript", "head"}
#: What may stand in a head; any other element ends one that has no end tag.
_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr"}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


class _Reader(HTMLParser):
    """Collects (kind, text, ref, caption) in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.text: list[str] = []
        self.hidden: list[str] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if text:
            self.parts.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden == ["head"] and tag not in _HEAD:
            self.hidden = []
        if tag in _HIDDEN:
            self.hidden.append(tag)
        elif tag in _MEDIA:
            given = dict(attrs)
            ref = given.get("src") or given.get("data")
            if ref and not self.hidden:
                self.flush()
                self.parts.append([_MEDIA[tag], None, ref, given.get("alt") or given.get("title")])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag not in _INLINE:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        elif tag == "figcaption" and self.caption is not None:
            text = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            self.caption = None
            for part in reversed(self.parts):  # the figure's medium
                if part[0] != "text":
                    part[3] = text or part[3]
                    break
        elif tag not in _INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The parts of a page; malformed HTML is read as far as it goes, null or '' gives none."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader.caption:
        reader.text += reader.caption
    reader.flush()
    return [{"position": k, "kind": kind, "text": text, "ref": ref, "caption": caption} for k, (kind, text, ref, caption) in enumerate(reader.parts)]


def _arrow(fields: dict[str, pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and parts (array of PARTS) of each page; one row per input row. A null or empty
    page has no parts; repeated rows and null ids stay; an empty table gives an empty result."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("key"), F.col(html_col).alias("html"))
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                yield _arrow({"key": None, "parts": kind}, [batch.column(0), pa.array([parse(h) for h in batch.column(1).to_pylist()], kind)])

    return rows.mapInArrow(released(run), f"key {rows.schema['key'].dataType.simpleString()}, parts {PARTS}").withColumnRenamed("key", id_col)


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 0 up to a positive multiple of WIDE."""
    return raw + b"\0" * (max(WIDE, -(-len(raw) // WIDE) * WIDE) - len(raw))


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def store_image(payload: bytes) -> bytes:
    """The PNG that holds ``payload``, a multiple of WIDE bytes, as samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDE)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", WIDE, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_image(media: bytes) -> bytes:
    """The samples of such a PNG; raises ValueError if it isn't one or a checksum is wrong."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, b"", None
    while at < len(media):
        size, name = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        if name == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            data += body
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image")
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not supported")
    return lines[:, 1:].tobytes()


def image_feature(payload: bytes) -> str:
    """Mean and deviation of the samples and the shares of eight levels, as text."""
    a = np.frombuffer(payload, np.uint8)
    levels = np.bincount(a >> 5, minlength=8) / len(a)
    return f"mean={a.mean():.4f};std={a.std():.4f};levels=" + ",".join(f"{x:.4f}" for x in levels)


def told(media: bytes | None) -> tuple:
    """(payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of a stored
    image, all null if there is none."""
    if media is None:
        return (None,) * 6
    payload = read_image(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), image_feature(payload)


def text_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, media): each distinct text's payload in its stored form. A null text is empty and
    its payload 64 zero bytes; an empty table gives an empty store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                held = {}
                for text in whole.column(0).slice(k, 500).to_pylist():
                    payload = padded((text or "").encode())
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in held:
                        held[digest] = store_image(payload)
                yield _arrow({"digest": pa.string(), "media": pa.binary()}, [list(held), list(held.values())])

    ship(docs.sparkSession)
    made = docs.select(F.col(text_col).alias("text")).mapInArrow(released(run), "digest string, media binary")
    return made.groupBy("digest").agg(F.first("media").alias("media"))


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes and html: a page of the text's lines, with a figure after the first half
    of them whose medium is the text's payload. A null text is empty; repeated rows and null ids
    stay; an empty table gives an empty result."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    fields = {"key": None, "n_bytes": pa.int64(), "html": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                size, html = [], []
                for text in batch.column(1).to_pylist():
                    raw = (text or "").encode()
                    size.append(len(raw))
                    own = [f"<p>{escape(x)}</p>" for x in (text or "").split("\n")]
                    figure = f'<figure><img src="{SCHEME}{hashlib.sha256(padded(raw)).hexdigest()}" alt="text"><figcaption>text of {len(raw)} bytes</figcaption></figure>'
                    half = -(-len(own) // 2)
                    html.append("".join([*own[:half], figure, *own[half:]]))
                yield _arrow(fields, [batch.column(0), size, html])

    return rows.mapInArrow(released(run), f"key {rows.schema['key'].dataType.simpleString()}, n_bytes bigint, html string").withColumnRenamed("key", id_col)


def resolved(parts: DataFrame, store: DataFrame) -> DataFrame:
    """``parts`` (one row per medium, with ref) with the column media of the store's row whose
    digest the reference names; null where the store has none, the reference is null or of
    another form. The store is hashed by digest once; many references to one digest are split by
    the engine's skew handling."""
    keyed = parts.withColumn("digest", F.expr(f"if(startswith(ref, '{SCHEME}'), substring(ref, {len(SCHEME) + 1}), null)"))
    return keyed.join(store, "digest", "left")


def assembled(found: DataFrame, store: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``found`` (``id_col``, parts) with the payloads beside their references: ``id_col`` and parts,
    in order, with a field media more, null for texts and for what the store doesn't hold. One
    row per input row, repeated rows, null ids and pages without parts included."""
    rows = found.select(F.col(id_col).alias("key"), "parts").withColumns({"r1": F.xxhash64("key", "parts"), "r2": F.xxhash64(F.lit(1), "parts", "key")})
    media = rows.select("r1", "r2", F.explode("parts").alias("p")).where("p.kind <> 'text'").dropDuplicates(["r1", "r2", "p"]).select("r1", "r2", "p.*")
    one = F.struct("position", "kind", "text", "ref", "caption", "media")
    media = resolved(media, store).groupBy("r1", "r2").agg(F.collect_list(one).alias("media"))
    texts = F.transform(F.filter("parts", lambda p: p["kind"] == "text"), lambda p: F.struct(*(p[c].alias(c) for c in ("position", "kind", "text", "ref", "caption")), F.lit(None).cast("binary").alias("media")))
    whole = F.array_sort(F.concat(texts, F.coalesce("media", F.slice(texts, 1, 0))), lambda a, b: a["position"] - b["position"])
    return rows.join(media, ["r1", "r2"], "left").select(F.col("key").alias(id_col), whole.alias("parts"))


def page_digests(pages: DataFrame) -> DataFrame:
    """page_id, n_parts, n_media and parts_sha256 of every page: of kind, text, reference and
    caption, null as '', each followed by a line feed, part by part."""
    told = F.transform("parts", lambda p: F.concat(*(x for c in ("kind", "text", "ref", "caption") for x in (F.coalesce(p[c], F.lit("")), F.lit("\n")))))
    media = F.size(F.filter("parts", lambda p: p["kind"] != "text"))
    return sequences(pages).select("page_id", F.size("parts").cast("bigint").alias("n_parts"), media.cast("bigint").alias("n_media"), F.sha2(F.array_join(told, ""), 256).alias("parts_sha256"))


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns, from the bytes that the join brings back, and position, caption and
    the number of parts around them.

    A null text is empty and its payload 64 zero bytes. One row per input row, repeated rows
    and null ids included; an empty table gives an empty result.
    """
    pages = text_pages(docs)
    found = sequences(pages.select(F.struct("doc_id", "n_bytes").alias("page"), "html"), "page")
    media = found.select("page.doc_id", "page.n_bytes", F.size("parts").alias("n_parts"), F.explode("parts").alias("p")).select("doc_id", "n_bytes", "n_parts", "p.position", "p.kind", "p.ref", "p.caption").where("kind <> 'text'")
    rows = resolved(media, text_store(docs)).select("doc_id", "n_bytes", "position", "caption", "n_parts", "media")
    fields = {"doc_id": None, "n_bytes": None, "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "position": None, "caption": None, "n_parts": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                made = list(zip(*(told(m) for m in batch.column(5).to_pylist())))
                yield _arrow(fields, [batch.column(0), batch.column(1), *made, *(batch.column(c) for c in (2, 3, 4))])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, position int, caption string, n_parts int")
