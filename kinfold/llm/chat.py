"""Chat formatting of typed content parts, in DataFrame and SQL functions only.

A turn's content is an array of parts. A visitor turns it into one string: a text part is
escaped, every other part becomes a numbered placeholder and leaves an attachment record with
the tokens it will expand to. Turns then stand between marks:

    <|turn assistant|>text<|end|>

In texts and roles ``&``, ``<`` and ``>`` are written ``&amp;``, ``&lt;`` and ``&gt;``, so a
mark cannot occur inside one and escaping is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, CLOSE, END = "<|turn ", "|>", "<|end|>"
#: Where a placeholder's number will stand; no escaped text holds it.
_NUMBER = "<#>"
#: Fields of a content part; all but ``type`` may be null.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of an image tile and its side in pixels, of a second of audio, of a document's page.
TILE_TOKENS, TILE_SIDE, SECOND_TOKENS, PAGE_TOKENS = 256, 512, 25, 1024
#: Code points of the blocks that a formatted string is cut into to find a span.
BLOCK = 1024


def escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def _tokens(p: Column) -> Column:
    """Tokens that a part's placeholder expands to; unknown sizes count as the least one."""
    tiles = F.ceil(F.coalesce(p["width"], F.lit(1)) / TILE_SIDE) * F.ceil(F.coalesce(p["height"], F.lit(1)) / TILE_SIDE)
    count = F.when(p["type"] == "image", tiles * TILE_TOKENS).when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(1.0)) * SECOND_TOKENS))
    return count.otherwise(F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS).cast("bigint")


def visited(parts: Column) -> tuple[Column, Column]:
    """(body, attachments) of an array of parts. Placeholders are numbered within the turn; the
    attachments are structs of number, type, ref and tokens, in the same order.

    Placeholders get their numbers after all parts are joined, where the body is cut at the
    mark that stands for a number, so the work grows with the parts and not with their square."""
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    other = F.filter(parts, lambda p: p.isNotNull() & (kind(p) != "text"))
    records = F.transform(other, lambda p, i: F.struct(i.cast("int").alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    shown = F.transform(
        parts,
        lambda p: F.when(p.isNull(), F.lit(""))
        .when(kind(p) == "text", escape(F.coalesce(p["text"], F.lit(""))))
        .otherwise(F.concat(F.lit("<|"), escape(p["type"]), F.lit(f" {_NUMBER}{CLOSE}"))),
    )
    pieces = F.split(F.array_join(shown, ""), _NUMBER, -1)
    body = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat((i - 1).cast("string"), p))), "")
    return F.coalesce(body, F.lit("")), F.coalesce(records, F.array().cast("array<struct<number:int,type:string,ref:string,tokens:bigint>>"))


def text_part(text: Column) -> Column:
    """An array of one text part."""
    empty = {name: F.lit(None).cast(kind) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(c.alias(n) for n, c in empty.items())))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One formatted string per conversation, from rows of turns.

    With ``parts_col`` (array of PART) the content is that; otherwise ``text_col`` is the only
    part. Returns ``conv_col``, formatted, loss_mask (array of start and end, in code points,
    of each assistant's body), attachments (array of turn_number, number, type, ref, tokens) and
    attachment_tokens. Turns go by ``turn_col``, nulls first, ties by role and body; repeated
    rows are turns of their own; a null role or text is empty; rows with a null conversation
    form one. An empty table gives an empty result.
    """
    body, attached = visited(F.col(parts_col).cast(f"array<{PART}>") if parts_col else text_part(F.col(text_col).cast("string")))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), body.alias("body"), attached.alias("attached"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(CLOSE))
    rows = rows.withColumn("shown", F.concat(head, "body", F.lit(END))).withColumn("head", F.char_length(head))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    upto = F.coalesce(F.sum(F.char_length("shown").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"number": F.row_number().over(order), "start": upto + F.col("head")})
    span = F.when(F.col("role") == "assistant", F.struct("start", (F.col("start") + F.char_length("body")).alias("end")))
    one = F.struct("number", "shown", span.alias("span"), "attached")
    out = rows.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("all"))
    spans = F.filter(F.transform("all", lambda t: t["span"]), lambda s: s.isNotNull())
    files = F.flatten(F.transform("all", lambda t: F.transform(t["attached"], lambda a: F.struct(t["number"].alias("turn_number"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = out.select(F.col("conv").alias(conv_col), F.array_join(F.transform("all", lambda t: t["shown"]), "").alias("formatted"), spans.alias("loss_mask"), files.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def _bodies(formatted: Column) -> Column:
    """The turns (array of role and the body as it stands) of a formatted string."""
    cut = F.split(formatted, r"<\|turn ")
    pieces = F.slice(cut, F.lit(2), F.size(cut))
    head = lambda p: F.instr(p, CLOSE)
    body = lambda p: F.substring(p, head(p) + len(CLOSE), F.char_length(p) - head(p) - len(CLOSE) + 1 - len(END))
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring(p, F.lit(1), head(p) - 1)).alias("role"), body(p).alias("body")))


def _parts(body: Column) -> Column:
    """The parts of a turn's body, in order: type, text (of a text) and number (of a placeholder)."""
    pieces = F.filter(F.split(body, r"(?=<\|)|(?<=\|>)", -1), lambda p: p != "")
    mark = lambda p: F.substring(p, F.lit(3), F.char_length(p) - 4)
    placed = lambda p: p.startswith("<|")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.when(placed(p), unescape(F.regexp_replace(mark(p), " [0-9]+$", ""))).otherwise(F.lit("text")).alias("type"),
            F.when(~placed(p), unescape(p)).alias("text"),
            F.when(placed(p), F.regexp_extract(mark(p), " ([0-9]+)$", 1).cast("int")).alias("number"),
        ),
    )


def read_back(formatted: Column) -> Column:
    """The turns that a formatted string holds: array of role, parts (type, text, number) and
    text, which is that of its text parts, joined."""
    told = lambda parts: F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    read = F.transform(_bodies(formatted), lambda t: F.struct(t["role"].alias("role"), _parts(t["body"]).alias("parts")))
    return F.transform(read, lambda t: F.struct(t["role"].alias("role"), t["parts"].alias("parts"), told(t["parts"]).alias("text")))


def masked(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped and joined. A span is cut from the blocks that it
    touches, as finding a code point takes time linear in the string that is searched."""
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def told(span: Column, held: Column) -> Column:
        first = F.floor(span["start"] / BLOCK).cast("int")
        count = F.floor((span["end"] - 1) / BLOCK).cast("int") - first + 1
        near = F.array_join(F.slice(held, first + 1, count), "")
        return unescape(F.substring(near, (span["start"] - first * BLOCK + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    return F.transform(F.array(blocks), lambda held: F.array_join(F.transform(mask, lambda s: told(s, held)), ""))[0]


def digests(turns: DataFrame) -> DataFrame:
    """The query's columns, read back from the formatted strings of all conversations and of
    one more, -7, whose texts look like marks."""
    spark = turns.sparkSession
    odd = spark.range(2).selectExpr("cast(-7 as bigint) as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", r"r'\### Assistant: </turn> ok' as text")
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(odd)
    out = format_turns(rows).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("loss_mask")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLE = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length({_ESCAPED.format("text")}) + length({_ESCAPED.format("role")}) + {len(TURN + CLOSE + END)})::bigint as formatted_chars
from c group by conv_id
"""
