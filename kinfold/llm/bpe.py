"""Byte-pair encoding and decoding with a prefix-sharing trie.

Spark hands Arrow batches to :class:`ByteBpe`. The distinct words of a batch that are not yet
known are inserted in byte order into a trie; the trie is walked depth first, and every node
gets the last token of its prefix's encoding. That token alone fixes the encoding: it is the
one token ending here that stays apart from the last token of the prefix before it. A prefix
that many words share is therefore computed once. Byte order makes the insertion order the
depth-first order, so only the open path of the trie is in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import released, ship

#: Fixed value: the split pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters whose classes no Unicode version of the last decade has changed. A text with any
#: other is split by the library's own pre-tokenizer, as the split pattern's engines differ there.
SETTLED = r"[\u0000-\u036F\u0391-\u03A1\u03A3-\u03CE\u0400-\u045F\u2010-\u2027\u2030-\u205E\u20AC\u3001-\u3003\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]*+"

#: Characters encoded together; bounds the words held at once.
CHUNK_CHARS = 1_500_000

#: Rows taken out of an Arrow batch at once.
ROWS = 500

#: Words kept encoded in a Python worker; when full, the cache starts anew.
CACHED_WORDS = 350_000

#: Pairs of tokens whose verdict a Python worker remembers.
CACHED_PAIRS = 400_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class ByteBpe:
    """One tokenizer in memory. Tokens are numbered inside by age: the 256 bytes, then the
    merges by rank; ``number`` gives the vocabulary's id as four little-endian bytes."""

    def __init__(self, definition: bytes):
        d = json.loads(definition)
        model, before = d["model"], d["pre_tokenizer"]
        odd = model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or d["normalizer"] or d["post_processor"]
        if odd or model.get("dropout") or model.get("ignore_merges") or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in d["added_tokens"]):
            raise ValueError("only plain byte-level BPE definitions are supported")
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        age = {c: b for b, c in enumerate(letters)} | {a + b: 256 + k for k, (a, b) in enumerate(pairs)}
        if len(age) != 256 + len(pairs):
            raise ValueError("two merges make the same token")
        self.count = len(age)
        self.left = [*range(256), *(age[a] for a, _ in pairs)]
        self.right = [*range(256), *(age[b] for _, b in pairs)]
        self.made = {self.left[t] * self.count + self.right[t]: t for t in range(256, self.count)}
        self.token = {bytes(back[c] for c in name): t for name, t in age.items()}
        self.longest = max(map(len, self.token))
        self.width = [len(b) for b in self.token]
        self.number = [vocab[name].to_bytes(4, "little") for name in age]
        self.bytes_of = {vocab[name]: b for name, b in zip(age, self.token, strict=True)}
        added = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.added = {k: v.to_bytes(4, "little") for k, v in added.items()}
        self.bytes_of |= {v: k.encode() for k, v in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(WORDS)
        self.settled = regex.compile(SETTLED)
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.texts = list(self.token)
        self.cache: dict[str, bytes] = {}
        self.verdicts: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether encoding the text of ``a`` followed by that of ``b`` keeps both tokens.

        Merges happen by age. Going back in time, the younger of the two border tokens is
        undone; a merge of the border pair counts if it came before the pair ceased to be.
        At equal age the left one of two merges happens first.
        """
        until = self.count + 1
        while True:
            merged = self.made.get(a * self.count + b)
            if merged is not None and merged < until:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                until, a = a, self.right[a]
            else:
                until, b = b + 1, self.left[b]

    def stands(self, t: int) -> bool:
        """Whether the text of token ``t`` encodes to ``t`` alone, by plain merging."""
        if t < 256:
            return True
        parts = list(self.texts[t])
        while len(parts) > 1:
            best = min((self.made.get(a * self.count + b, self.count) for a, b in zip(parts, parts[1:])), default=self.count)
            if best == self.count:
                return False
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and self.made.get(parts[k] * self.count + parts[k + 1]) == best:
                    out.append(best)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts == [t]

    def learn(self, fresh: set[str]) -> None:
        """Put the encodings of these words into the cache."""
        if len(self.cache) + len(fresh) > CACHED_WORDS:
            self.cache = {}
        if len(self.verdicts) > CACHED_PAIRS:
            self.verdicts = {}
        token, width, number, count, longest = self.token.get, self.width, self.number, self.count, self.longest
        verdicts, whole, apart = self.verdicts, self.whole, self.apart
        last = [0]  # last[d]: last token of the open path's first d bytes
        path = b""
        for word in sorted(w.encode() for w in fresh):
            d = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                d += 1
            del last[d + 1 :]
            for d in range(d + 1, len(word) + 1):
                for n in range(d if d < longest else longest, 0, -1):
                    t = token(word[d - n : d])
                    if t is None:
                        continue
                    if n == d:
                        good = whole.get(t)
                        if good is None:
                            good = whole[t] = self.stands(t)
                    else:
                        pair = last[d - n] * count + t
                        good = verdicts.get(pair)
                        if good is None:
                            good = verdicts[pair] = apart(last[d - n], t)
                    if good:
                        last.append(t)
                        break
            path = word
            ids, d = [], len(word)
            while d:
                t = last[d]
                ids.append(number[t])
                d -= width[t]
            ids.reverse()
            self.cache[word.decode()] = b"".join(ids)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self.settled.fullmatch(text):
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit little-endian integers."""
        split = []
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            split.append([[p] if k % 2 else self.split(p) for k, p in enumerate(parts)])
        fresh = {w for parts in split for p in parts[::2] for w in p}
        known = fresh - self.cache.keys()
        if known:
            if len(self.cache) + len(known) > CACHED_WORDS:
                known = fresh  # the cache starts anew
            self.learn(known)
        got, out = self.cache.__getitem__, []
        for parts in split:
            out.append(b"".join(self.added[p[0]] if k % 2 else b"".join(map(got, p)) for k, p in enumerate(parts)))
        return out

    def forget(self) -> None:
        """Drop what was remembered of words and pairs."""
        self.cache, self.verdicts = {}, {}

    def decode(self, ids: bytes) -> str:
        """The text of such ids; bytes that are not UTF-8 become U+FFFD, and ids that the
        vocabulary does not hold are left out, as the library does."""
        numbers = memoryview(ids).cast("I")
        try:
            found = list(map(self.bytes_of.__getitem__, numbers))
        except KeyError:
            found = [self.bytes_of.get(n, b"") for n in numbers]
        return b"".join(found).decode("utf-8", "replace")


_loaded: dict[int, ByteBpe] = {}


def _bpe(definition: bytes) -> ByteBpe:
    key = hash(definition)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(definition)
    return _loaded[key]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK_CHARS characters; a longer text is a range of its own."""
    start = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text) > CHUNK_CHARS:
            yield start, k
            start, held = k, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Encode whole texts; with ``decoded``, also decode the ids again.

    Returns ``id_col``, ``ids`` (binary, unsigned 32-bit little-endian) and, if asked for,
    ``decoded``. One row per input row in any number and order: repeated rows and null keys
    are kept, a null or empty text gives no ids and an empty decoded text, an empty table an
    empty result. Special tokens written in a text become their id, as the library does.
    The tokenizer's file is read on the driver and sent once to each executor.
    """
    ship(df.sparkSession)
    with open(tokenizer_path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(sent.value)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                for a, b in _chunks(texts):
                    ids = bpe.encode(texts[a:b])
                    cols = [keys.slice(a, b - a), pa.array(ids, pa.binary())]
                    if decoded:
                        cols.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, ["key", "ids", "decoded"][: len(cols)])
        bpe.forget()

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(released(run), f"key {kind}, ids binary" + ", decoded string" * decoded)
    return out.withColumnRenamed("key", id_col)


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded`` for ids as :func:`encode` gives them; null ids give '', and ids
    outside the vocabulary are left out. Repeated rows and null keys are kept."""
    ship(df.sparkSession)
    with open(tokenizer_path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(id_col).alias("key"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(bpe.decode, part.column(1).to_pylist()), pa.string())], ["key", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", id_col)


def digests(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """Contract of the query: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encode(df, tokenizer_path, decoded=True)
    return out.select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
