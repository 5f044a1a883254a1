"""Personal data in texts, in SQL functions only: fixed base patterns, and boosted trees over
the candidates of wider generators.

Four base patterns give spans that always stay. Wider generators propose further spans, which
may overlap: written-out and bracketed addresses of mail and network, card numbers with unusual
separators, national telephone numbers, secrets. Of each candidate a few features are taken,
from its format and from the words before it. Gradient-boosted trees, fitted on labelled examples
that this module makes up, become one SQL expression; a candidate counts if its score passes the
threshold calibrated for its kind on examples held out. All is row by row: nothing is shuffled,
and no document waits for another.

Patterns are written so that Java's matcher neither recurses nor tries a run of characters
twice: a run is only entered at its start or where the last match ended. Places of matches are
added up in blocks, and whether a candidate touches a base span is found by bisection, so the
work grows with a text's matches and not with their square.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import Trees, fit

KINDS = ["email", "ip", "card", "phone", "secret"]
_ADDRESS, _NUMBER = "A-Za-z0-9._%+-", "0-9"
BASE = {
    "email": rf"(?:\G|(?<![{_ADDRESS}]))[{_ADDRESS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates by the kind they would be.
WIDE = {
    "email": rf"(?<![{_ADDRESS}])[{_ADDRESS}]++\x20?[\[({{]at[\])}}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({{]dot[\])}}])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\x20?[\[({](?:\.|dot)[\])}]\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])|(?=[0-9:]*+[a-fA-F]|[0-9]*+(?::[0-9]++)*+::)(?:[0-9a-fA-F]{1,4}:){1,7}(?::|(?::?[0-9a-fA-F]{1,4}){1,7})(?![0-9A-Za-z:]))",
    "card": r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[._/\x20-]{1,3}[0-9]{4}){3}(?:[._/\x20-]{1,3}[0-9]{1,3})?(?![0-9A-Za-z])|(?<![0-9A-Za-z.+-])3[0-9]{3}[._/\x20-]{1,3}[0-9]{6}[._/\x20-]{1,3}[0-9]{5}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
}
#: What a text must contain for a pattern to be tried.
_NEEDS = {"email": "contains(text, '@')", "ip": "contains(text, '.')", "card": "true", "phone": "contains(text, '+')"}
_WIDE_NEEDS = {"email": "rlike(text, '[\\\\[({]at[\\\\])}]')", "ip": "rlike(text, '[0-9a-fA-F]:[0-9a-fA-F:]|[\\\\[({](?:[.]|dot)[\\\\])}]')", "card": "rlike(text, '[0-9]{4}[._/\\\\x20-]{1,3}[0-9]{4,6}[._/\\\\x20-]{1,3}[0-9]{4,5}')", "phone": "true", "secret": "true"}

_EMPTY = "cast(array() as array<struct<start:int,end:int,m:string,before:string,after:string>>)"
_LUHN = """aggregate(transform(split(regexp_replace(reverse({0}), '[^0-9]', ''), '(?<=.)(?=.)'), (d, i) -> (1 + i % 2) * cast(concat('0', d) as int)),
        0, (s, d) -> s + d - if(d > 9, 9, 0)) % 10"""
_VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": f"length(regexp_replace(x.m, '[^0-9]', '')) between 14 and 19 and {_LUHN.format('x.m')} = 0",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) between 10 and 15",
}

#: Features of a candidate c (kind, start, end, m, before, after) as SQL.
FEATURES = {
    "kind": "cast(c.kind as double)",
    "length": "cast(char_length(c.m) as double)",
    "digits": "cast(length(regexp_replace(c.m, '[^0-9]', '')) as double)",
    "capitals": "length(regexp_replace(c.m, '[^A-Z]', '')) / char_length(c.m)",
    "hex_share": "length(regexp_replace(c.m, '[^0-9a-f]', '')) / char_length(c.m)",
    "marks": "cast(length(regexp_replace(c.m, '[A-Za-z0-9]', '')) as double)",
    "runs": "cast(regexp_count(c.m, '[0-9]++[A-Za-z]++') as double)",
    "assigned": "if(rlike(c.before, '(?i)(?:key|token|secret|passw(?:or)?d|pwd|auth|bearer|credential)[\\\\w-]*[\\\\x20]*[=:][\\\\x20]*[\"\\']?$'), 1D, 0D)",
    "called": "if(rlike(c.before, '(?i)(?:tel|phone|call|mobile|fax|cell|sms|whatsapp)\\\\w*[.:]?[\\\\x20]*$'), 1D, 0D)",
    "mailed": "if(rlike(c.before, '(?i)(?:mail|contact|write|reach)\\\\w*(?:[\\\\x20]\\\\w+)?[:]?[\\\\x20]*$'), 1D, 0D)",
    "counted": "if(rlike(c.before, '(?i)(?:no|nr|id|isbn|order|commit|version|invoice|page|sha|build|ref)\\\\w*[.:#]?[\\\\x20]*$'), 1D, 0D)",
    "quoted": "if(rlike(c.before, '[\"\\']$') and rlike(c.after, '^[\"\\']'), 1D, 0D)",
    "grouped": "if(rlike(c.m, '^[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$'), 1D, 0D)",
    "groups": "cast(regexp_count(c.m, '[0-9A-Za-z]++') as double)",
    "sums_up": f"if({_LUHN.format('c.m')} = 0, 1D, 0D)",
    "paid": "if(rlike(c.before, '(?i)(?:card|visa|master|amex|pay|credit|debit|charge|cc)\\\\w*(?:[\\\\x20]\\\\w+)?[.:#]?[\\\\x20]*$'), 1D, 0D)",
    "networked": "if(rlike(c.before, '(?i)(?:ip|host|addr|server|from|login|client|ping|peer|v6)\\\\w*(?:[\\\\x20]\\\\w+)?[.:=]?[\\\\x20]*$'), 1D, 0D)",
    "coloned": "cast(length(regexp_replace(c.m, '[^:]', '')) as double)",
    "lettered": "cast(length(regexp_replace(c.m, '[^a-fA-F]', '')) as double)",
    "dotted": "if(rlike(c.m, '(?i)dot|[.][A-Za-z]{2,}$'), 1D, 0D)",
}


#: Matches whose places are added up together, and code points of a piece of a redacted text.
_BLOCK, CUT = 256, 4096


def _located(pattern: str, needs: str) -> Column:
    """All matches as array of start, end (code points), m and what stands around, in the column
    ``text``: up to 32 characters before, none from before the last match, and 8 after.

    Splitting by the same pattern gives what lies between the matches, and so their places: in
    blocks from the block's start, and then from the text's."""
    sql = pattern.replace("\\", "\\\\").replace("'", "\\'")
    told = "named_struct('start', s.at + char_length(z['0']), 'end', s.at + char_length(z['0']) + char_length(z['1']), 'm', z['1'], 'before', right(z['0'], 32), 'after', substring(s.all[s.n + 1]['0'], 1, 8))"
    blocks = f"""transform(array(arrays_zip(split(text, '{sql}', -1), regexp_extract_all(text, '{sql}', 0))),
        all -> transform(sequence(0, cast(floor((size(all) - 1) / {_BLOCK}) as int)), k -> aggregate(slice(all, k * {_BLOCK} + 1, {_BLOCK}),
        named_struct('at', 0, 'n', k * {_BLOCK}, 'out', {_EMPTY}),
        (s, z) -> if(z['1'] is null, s, named_struct(
            'at', s.at + char_length(z['0']) + char_length(z['1']), 'n', s.n + 1,
            'out', concat(s.out, array({told.replace("s.all", "all")})))))))[0]"""
    starts = "aggregate(b, array(0), (s, x) -> concat(s, array(element_at(s, -1) + x.at)))"
    moved = f"transform(array({starts}), s -> flatten(transform(b, (x, k) -> transform(x.out, y -> named_struct('start', y.start + s[k], 'end', y.end + s[k], 'm', y.m, 'before', y.before, 'after', y.after)))))[0]"
    return F.expr(f"if({needs} and regexp_instr(text, '{sql}') > 0, transform(array({blocks}), b -> {moved})[0], {_EMPTY})")


def _touches(spans: str) -> str:
    """SQL: whether the candidate c touches one of ``spans``, sorted and apart: bisection for the
    last one that starts before c's end."""
    last = f"""aggregate(sequence(1, length(bin(size({spans})))), named_struct('lo', 0, 'hi', size({spans})), (s, i) -> if(s.lo >= s.hi, s,
        if({spans}[shiftright(s.lo + s.hi, 1)].start < c.end, named_struct('lo', shiftright(s.lo + s.hi, 1) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', shiftright(s.lo + s.hi, 1)))), s -> s.lo)"""
    return f"(size({spans}) > 0 and transform(array({last}), n -> n > 0 and {spans}[n - 1].end > c.start)[0])"


def candidates(texts: DataFrame) -> DataFrame:
    """``texts`` (with a column text, not null) and arrays: base spans, candidates that touch none."""
    out = texts.withColumns({f"b_{k}": _located(p, _NEEDS[k]) for k, p in BASE.items()} | {f"w_{k}": _located(p, _WIDE_NEEDS[k]) for k, p in WIDE.items()})
    out = out.withColumns({f"b_{k}": F.expr(f"transform(filter(b_{k}, x -> {_VALID[k]}), x -> named_struct('start', x.start, 'kind', {KINDS.index(k)}, 'end', x.end))") for k in BASE})
    wide = [f"transform(w_{k}, x -> named_struct('kind', {KINDS.index(k)}, 'start', x.start, 'end', x.end, 'm', x.m, 'before', x.before, 'after', x.after))" for k in WIDE]
    out = out.withColumn("base", F.expr(f"array_sort(concat({', '.join(f'b_{k}' for k in BASE)}))"))
    out = out.withColumn("wide", F.expr(f"filter(concat({', '.join(wide)}), c -> not ({' or '.join(_touches(f'b_{k}') for k in BASE)}))"))
    return out.drop(*(f"b_{k}" for k in BASE), *(f"w_{k}" for k in WIDE))


def examples(count: int = 4000, seed: int = 11) -> list[tuple[int, str, str, int]]:
    """Made-up texts of one candidate each: (number, text, the candidate or '', label).

    Half hold private data in usual wording, half look alike but are not private: commit
    hashes, version numbers, order numbers, dates, times, hardware addresses, figures that fail
    the cards' check digit, long names with digits.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiourstlnmdb") for _ in range(r.randint(2, 9)))
    some = lambda n, of: "".join(r.choice(of) for _ in range(n))
    hexa, mixed, figures = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"
    out = []
    sep = lambda: r.choice([".", "_", "/", " / ", "  ", " - ", "--"])

    def card(valid: bool) -> str:
        """Sixteen figures in fours, whose check digit is right or wrong."""
        d = r.choice("3456") + some(14, figures)
        rest = sum(x - 9 * (x > 9) for x in (int(c) * (2 - i % 2) for i, c in enumerate(d))) % 10
        d += str((10 - rest + (0 if valid else r.randrange(1, 10))) % 10)
        return sep().join(d[i : i + 4] for i in range(0, 16, 4))

    for k in range(count):
        label = k % 2
        form = r.randrange(10)
        before, after = word() + " " + word() + " ", " " + word()
        if form < 3 and label:
            name = r.choice(["token", "api_key", "apiKey", "secret", "password", "auth-token", "access_key", "API_TOKEN", "client_secret"])
            mark, quote = r.choice([" = ", "=", ": "]), r.choice(['"', '"', "'", ""])
            m = some(r.choice([20, 24, 32, 40, 40, 64]), r.choice([hexa, hexa, mixed]))
            before, after = before + name + mark + quote, quote + after
        elif form < 3:
            m = r.choice([some(40, hexa), some(32, hexa), "-".join([some(8, hexa), *(some(4, hexa) for _ in range(3)), some(12, hexa)]), f"{word()}-{word()}_{word()}{some(2, figures)}-{word()}", some(18, figures), f"{word()}/{word()}/{word()}{some(4, figures)}"])
            before += r.choice(["commit ", "sha ", "id ", "build ", "", "", "file ", "see "])
        elif form < 5 and label:
            a, b, c = some(3, figures), some(3, figures), some(4, figures)
            m = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])
            before += r.choice(["call ", "tel. ", "phone: ", "mobile ", "fax ", "Tel: ", "", "reach me at "])
        elif form < 5:
            m = r.choice([f"20{some(2, figures)}-{some(4, figures)}-{some(4, figures)}", f"{some(2, figures)} {some(3, figures)} {some(3, figures)}", f"{some(4, figures)} {some(4, figures)} {some(4, figures)}", f"{some(2, figures)}.{some(3, figures)}.{some(3, figures)}", f"{some(3, figures)}-{some(4, figures)}-{some(5, figures)}"])
            before += r.choice(["order ", "no. ", "isbn ", "ref ", "", "page ", "version ", "of "])
        elif form < 6 and label:
            m = f"{word()}{r.choice(['', '.', '_'])}{word()}{r.choice(['[at]', ' [at] ', '(at)', ' (at) '])}{word()}{r.choice(['.', '[dot]', ' [dot] ', ' (dot) '])}{r.choice(['com', 'org', 'net', 'de'])}"
            before += r.choice(["mail ", "contact ", "write to ", ""])
        elif form < 6:
            m = f"{word()} {r.choice(['(at)', '[at]'])} {some(2, figures)}{word()}.{some(1, figures)}"
            before += r.choice(["sold ", "seen ", "", "ref "])
        elif form < 8 and label:
            parts = [str(r.randrange(256)) for _ in range(4)]
            eight = [some(r.randint(1, 4), hexa) for _ in range(8)]
            m = r.choice([r.choice(["[.]", "(.)", "[dot]", " [dot] "]).join(parts), ":".join(eight), ":".join(eight), f"{':'.join(eight[:3])}::{':'.join(eight[3:5])}"])
            before += r.choice(["ip ", "host ", "from ", "address: ", "server ", "", "login from "])
        elif form < 8:
            m = r.choice([f"{r.randrange(10, 24)}:{r.randrange(10, 60)}:{r.randrange(10, 60)}", f"{r.randrange(1, 9)}:{r.randrange(10, 60)}:{r.randrange(10, 60)}", ":".join(some(2, hexa) for _ in range(6)), f"{r.randrange(300, 999)}[.]{r.randrange(300, 999)}[.]{r.randrange(300, 999)}[.]{r.randrange(300, 999)}", f"{word()[:0]}{some(2, 'abcdef')}::{some(2, 'abcdef')}"])
            before += r.choice(["at ", "on ", "ratio ", "verse ", "", "mac ", "use "])
        elif label:
            m = card(True)
            before += r.choice(["card ", "visa ", "pay with ", "credit card: ", "", "charged "])
        else:
            m = card(False)
            before += r.choice(["order ", "no. ", "serial ", "", "ref ", "isbn "])
        out.append((k, before + m + after, m, label))
    return out


def sql_of(trees: Trees, names: list[str]) -> str:
    """The trees' score of a struct f of features as one SQL expression."""

    def node(at: int) -> str:
        if trees.low[at] == at:
            return f"{float(trees.value[at])!r}D"
        return f"if(f.{names[trees.feature[at]]} <= {float(trees.limit[at])!r}D, {node(int(trees.low[at]))}, {node(int(trees.high[at]))})"

    total = " + ".join(["0D", *(node(int(r)) for r in trees.roots)])
    return f"1D / (1D + exp(-({trees.base!r}D + {total})))"


def _featured() -> str:
    return "named_struct(" + ", ".join(f"'{k}', cast({v} as double)" for k, v in FEATURES.items()) + ")"


_trained: dict[tuple[str, float], tuple[str, dict[str, float]]] = {}


def train(spark: SparkSession, precision: float = 0.995) -> tuple[str, dict[str, float]]:
    """(score expression, threshold per kind). The examples' features are computed by the same
    SQL as the documents'; a third of the examples calibrates the thresholds: the least score
    from which ``precision`` of a kind's held-out candidates are private, at least one half. Done
    once a session."""
    key = spark.sparkContext.applicationId, precision
    if key not in _trained:
        _trained[key] = _fitted(spark, precision)
    return _trained[key]


def _fitted(spark: SparkSession, precision: float) -> tuple[str, dict[str, float]]:
    made = examples()
    table = candidates(spark.createDataFrame(made, "number int, text string, m string, label int"))
    got = table.select("number", "label", F.col("m").alias("whole"), F.explode("wide").alias("c")).select("number", "label", F.expr("position(c.m, whole) > 0 or position(whole, c.m) > 0").alias("same"), F.expr(_featured()).alias("f"))
    rows = got.select("number", "same", "label", "f.*").orderBy("number", "kind").collect()
    names = list(FEATURES)
    x = np.array([[float(r[n]) for n in names] for r in rows])
    y = np.array([float(r["label"] and r["same"]) for r in rows])
    held = np.array([r["number"] // 2 % 3 == 0 for r in rows])
    trees = fit(x[~held], y[~held], trees=24, depth=3, rate=0.3, bins=24, ridge=1.0, least=2.0)
    score, limits = trees.score(x[held]), {}
    for k, kind in enumerate(KINDS):
        at = np.flatnonzero(x[held][:, 0] == k)
        order = at[np.argsort(-score[at])]
        share = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= precision)
        limits[kind] = max(0.5, float(score[order[good[-1]]])) if len(good) else 2.0
    return sql_of(trees, names), limits


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The private spans of each text.

    Returns ``id_col``, text (null as ''), base and added: arrays of start, kind (a place in
    KINDS), end, sorted; places count code points, ends are exclusive. Base spans are the
    leftmost non-overlapping matches of each base pattern that pass its test. An added span
    touches no base span, and none of its kind that starts before it. One row per input row;
    repeated rows and null ids stay; an empty table gives an empty result.
    """
    score, limits = train(docs.sparkSession)
    rows = candidates(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    limit = "case c.kind " + " ".join(f"when {k} then {limits[kind]!r}D" for k, kind in enumerate(KINDS)) + " end"
    rows = rows.withColumn("scored", F.expr(f"transform(wide, c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end, 'limit', {limit}, 'f', {_featured()}))"))
    added = f"array_sort(transform(filter(scored, s -> exists(array(s.f), f -> {score} >= s.limit)), s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end)))"
    return rows.select(id_col, "text", "base", F.expr(added).alias("added"))


def redacted(found: DataFrame) -> DataFrame:
    """``found`` with a column redacted: the text with each maximal private run as [PRIVATE].

    The text is cut into pieces of CUT code points, from which what stays is put together, and
    runs are found in blocks that know the greatest end before them."""
    spans = "transform(array(array_sort(concat(base, added))), all -> transform(sequence(0, cast(floor(greatest(size(all) - 1, 0) / {0}) as int)), k -> slice(all, k * {0} + 1, {0})))[0]".format(_BLOCK)
    ends = "aggregate(blocks, array(0), (s, x) -> concat(s, array(greatest(element_at(s, -1), coalesce(array_max(transform(x, y -> y.end)), 0)))))"
    gaps = """flatten(transform(blocks, (x, k) -> aggregate(x, named_struct('at', ends[k], 'out', cast(array() as array<struct<a:int,b:int>>)), (s, y) -> named_struct(
        'at', greatest(s.at, y.end), 'out', if(y.start >= s.at and y.end > s.at, concat(s.out, array(named_struct('a', s.at, 'b', y.start))), s.out)), s -> s.out)))"""
    kept = f"array_join(transform(if(g.a < g.b, sequence(cast(floor(g.a / {CUT}) as int), cast(floor((g.b - 1) / {CUT}) as int)), cast(array() as array<int>)), j -> substring(pieces[j], greatest(g.a - j * {CUT}, 0) + 1, least(g.b - j * {CUT}, {CUT}) - greatest(g.a - j * {CUT}, 0))), '')"
    rows = found.withColumns({"pieces": F.expr(f"regexp_extract_all(text, '(?s).{{1,{CUT}}}', 0)"), "blocks": F.expr(spans)})
    rows = rows.withColumn("ends", F.expr(ends)).withColumn("gaps", F.expr(gaps))
    last = F.expr(f"transform(array(named_struct('a', element_at(ends, -1), 'b', char_length(text))), g -> {kept})[0]")
    out = F.concat(F.array_join(F.expr(f"transform(gaps, g -> concat({kept}, '[PRIVATE]'))"), ""), last)
    return rows.withColumn("redacted", out).drop("pieces", "blocks", "ends", "gaps")


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns: counts of the base kinds, base_sha256 and all spans."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    told = lambda spans: F.expr(f"array_join(transform({spans}, x -> concat({kinds}[x.kind], ':', x.start, ':', x.end)), ',')")
    found = find(docs)
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("array_sort(concat(base, added))").alias("spans"))
