"""Transforms of term lists: builders that turn an array<string> column into another."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]

#: Name prefixes that belong to the word after them.
PREFIXES = ["DE", "DEL", "LO", "MC", "MAC", "ST", "DU", "VAN", "SAINT", "D'", "L'", "O'", "LE", "LA", "VON", "O", "DI", "LI"]
#: Unicode's white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"


def whole_number(value: Any) -> int:
    """An argument as an int: floats lose their fraction, anything else is an error."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{value!r} is not a number")
    return int(value)


def _argument(arguments: dict, name: str) -> Any:
    if name not in arguments:
        raise ValueError(f"the argument {name} is missing")
    return arguments[name]


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def substr(arguments: dict) -> Step:
    """Characters ``begin`` up to but not including ``end``. Short texts give what there is;
    with ``strict`` they raise."""
    begin, end = (whole_number(_argument(arguments, k)) for k in ("begin", "end"))
    if begin < 0:
        raise ValueError("begin must not be negative")

    def one(t: Column) -> Column:
        part = F.substring(t, begin + 1, max(0, end - begin))
        if not arguments.get("strict"):
            return part
        return F.when((F.length(t) >= end) & F.lit(begin <= end), part).otherwise(F.raise_error(F.lit("substr: the text is too short")))

    return lambda terms: F.transform(terms, one)


def upcase(_: dict) -> Step:
    """Upper case. Letters whose upper case is longer (as in German) become longer."""
    return lambda terms: F.transform(terms, F.upper)


def trim(_: dict) -> Step:
    """Without white space at either end."""
    return lambda terms: F.transform(terms, trimmed)


def killafter(arguments: dict) -> Step:
    """What stands before the first ``sep``; all if there is none, nothing if it is empty."""
    sep = _argument(arguments, "sep")
    if not isinstance(sep, str):
        raise ValueError("sep must be a string")
    return lambda terms: F.transform(terms, lambda t: F.substring_index(t, sep, 1) if sep else F.lit(""))


def split_name(text: Column) -> Column:
    """The names in a text, each with the prefixes before it. Hyphens part words; prefixes that
    nothing follows are dropped."""
    words = F.transform(F.split(F.replace(trimmed(text), F.lit("-"), F.lit(" ")), " "), trimmed)
    words = F.filter(words, lambda w: w != "")
    state = F.struct(F.array().cast("array<string>").alias("names"), F.lit("").alias("held"))

    def step(s: Column, w: Column) -> Column:
        run = F.concat(s["held"], w)
        prefix = w.isin(PREFIXES)
        names = F.when(prefix, s["names"]).otherwise(F.concat(s["names"], F.array(run)))
        return F.struct(names.alias("names"), F.when(prefix, F.concat(run, F.lit(" "))).otherwise(F.lit("")).alias("held"))

    return F.aggregate(words, state, step, lambda s: s["names"])


def split(_: dict) -> Step:
    """Every term's names, in one list."""
    return lambda terms: F.flatten(F.transform(terms, split_name))


REGISTRY: dict[str, Callable[[dict], Step]] = {"substr": substr, "upcase": upcase, "trim": trim, "split": split, "killafter": killafter}


def register(name: str, factory: Callable[[dict], Step]) -> None:
    """Add a transform: a factory from its arguments to a step."""
    REGISTRY[name] = factory


def build(name: str, arguments: dict) -> Step:
    if name not in REGISTRY:
        raise ValueError(f"there is no transform {name!r}")
    return REGISTRY[name](arguments)


def joined(attrs: tuple[str, ...], present: list[str]) -> Column:
    """The attributes' values in one string; missing and null ones are empty."""
    return F.concat(F.lit(""), *(F.coalesce(F.col(f"`{a}`").cast("string"), F.lit("")) for a in attrs if a in present))


def terms(field, present: list[str]) -> Column:
    """The terms of a field (FieldDef) as array<string>."""
    out = F.array(joined(field.attrs, present))
    for t in field.transforms:
        out = build(t.function, t.arguments)(out)
    return out
