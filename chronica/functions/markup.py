"""Nested brackets and character entities as column expressions: no Python worker reads a text."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _walk(steps: Column) -> Column:
    """Depths before, between and after steps of plus and minus one; a step below nothing stays there.

    In two levels: steps are cut into blocks of about the root of their number. A block
    that sums to s and ends at a when begun at nothing ends at max(d + s, a) when begun
    at d, so blocks are begun in turn and each place looks back only to its block's start.
    """
    down = lambda d, x: F.greatest(d + x, F.lit(0))
    size = F.ceil(F.sqrt(F.greatest(F.size(steps), F.lit(1)))).cast("int")

    def cut(z: Column) -> Column:
        count = F.ceil(F.size(steps) / z).cast("int")
        every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(every, lambda b: F.slice(steps, b * z + 1, z))

    def depths(blocks: Column) -> Column:
        zero = F.lit(0)
        ends = F.transform(
            blocks, lambda b: F.struct(F.aggregate(b, zero, lambda s, x: s + x).alias("s"), F.aggregate(b, zero, down).alias("a"))
        )

        def placed(e: Column) -> Column:
            begun = F.transform(e, lambda _, i: F.aggregate(F.slice(e, 1, i), zero, lambda d, x: F.greatest(d + x["s"], x["a"])))
            per_block = lambda d: F.transform(
                blocks, lambda b, k: F.transform(b, lambda _, i: F.aggregate(F.slice(b, 1, i + 1), F.get(d, k), down))
            )
            return let(begun, lambda d: F.flatten(per_block(d)))

        return F.concat(F.array(zero), let(ends, placed))

    return let(size, lambda z: let(cut(z), depths))


def without_nested(text: Column, start: str, end: str) -> Column:
    """Text without what stands between ``start`` and its ``end``, both included, at any
    depth. A start that nothing ends and an end that nothing starts stay."""
    either = f"{re.escape(start)}|{re.escape(end)}"

    def kept(t: Column) -> Column:
        both = F.struct(F.regexp_extract_all(t, F.lit(either), F.lit(0)).alias("marks"), F.split(t, either, -1).alias("gaps"))
        return let(both, lambda b: let(_steps(b["marks"], start), lambda s: _joined(b["marks"], b["gaps"], s, start)))

    return let(text, lambda t: F.when(t.contains(start) & t.contains(end), kept(t)).otherwise(t))


def _steps(marks: Column, start: str) -> Column:
    """Per gap: brackets open there, and brackets still to be closed after it, each seen from one side."""
    steps = F.transform(marks, lambda m: F.when(m == start, 1).otherwise(-1))
    back = F.reverse(F.transform(marks, lambda m: F.when(m == start, -1).otherwise(1)))
    return F.struct(let(steps, _walk).alias("open"), F.reverse(let(back, _walk)).alias("due"))


def _joined(marks: Column, gaps: Column, depth: Column, start: str) -> Column:
    def part(gap: Column, i: Column) -> Column:
        here = F.when((F.get(depth["open"], i) > 0) & (F.get(depth["due"], i) > 0), "").otherwise(gap)
        mark = F.get(marks, i)
        paired = F.when(mark == start, F.get(depth["due"], i + 1) > 0).otherwise(F.get(depth["open"], i) > 0)
        return F.concat(here, F.when(mark.isNull() | paired, "").otherwise(mark))

    return F.array_join(F.transform(gaps, part), "")


# --- entities ---------------------------------------------------------------
_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Numbers that do not stand for the character of that number, of those that may not.
_ODD = {
    n: html.unescape(f"&#{n};")
    for n in [*range(0xA0), *range(0xFDD0, 0xFDF0), *[p << 16 | e for p in range(17) for e in (0xFFFE, 0xFFFF)]]
    if html.unescape(f"&#{n};") != chr(n)
}
# Names that count without a semicolon, by length.
_OPEN_NAMES = [n for n in entities.html5 if not n.endswith(";")]


def _tables() -> Column:
    """Characters by the first two letters of a name and the name, and those of odd numbers."""
    table: dict[str, dict[str, str]] = {}
    for name, value in entities.html5.items():
        table.setdefault(name[:2], {})[name] = value
    told = json.dumps({"names": table, "odd": {str(k): v for k, v in _ODD.items()}})
    return F.from_json(F.lit(told), "names map<string,map<string,string>>, odd map<string,string>")


def _numbered(token: Column, odd: Column) -> Column:
    hexadecimal = token.rlike("^#[xX]")
    digits = F.regexp_replace(token, "^#[xX]?0*|;$", "")
    code = F.when(digits == "", "0").when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits)
    number = F.when(F.length(digits) > 9, F.lit(0x110000)).otherwise(code.cast("bigint"))
    whole = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return let(
        number,
        lambda n: F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").otherwise(
            F.coalesce(F.try_element_at(odd, n.cast("string")), whole(n))
        ),
    )


def _named(token: Column, names: Column) -> Column:
    """The character of a name, or of the longest beginning that is one without a semicolon."""
    value = lambda name: F.try_element_at(F.try_element_at(names, F.substring(name, 1, 2)), name)
    longest = max(map(len, _OPEN_NAMES))
    shortest = min(map(len, _OPEN_NAMES))
    begun = [
        F.when(F.length(token) > n, F.concat(value(F.substring(token, 1, n)), F.substr(token, F.lit(n + 1)))) for n in range(longest, shortest - 1, -1)
    ]
    return F.coalesce(value(token), *begun, F.concat(F.lit("&"), token))


def unescaped(text: Column) -> Column:
    """Character entities, named and numeric, as characters, the way browsers read them."""

    def decoded(t: Column) -> Column:
        both = F.struct(F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(1)).alias("tokens"), F.split(t, _ENTITY, -1).alias("gaps"))

        def char(token: Column, tables: Column) -> Column:
            numbered = F.when(token.startswith("#"), _numbered(token, tables["odd"]))
            return F.when(token.isNull(), "").otherwise(F.coalesce(numbered, _named(token, tables["names"])))

        def part(b: Column, tables: Column) -> Column:
            read = lambda gap, i: F.concat(gap, let(F.get(b["tokens"], i), lambda k: char(k, tables)))
            return F.array_join(F.transform(b["gaps"], read), "")

        return let(both, lambda b: let(_tables(), lambda tables: part(b, tables)))

    return let(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))
