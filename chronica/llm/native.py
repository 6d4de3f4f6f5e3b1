"""Column expressions for regular-expression matches: texts between, texts matched, offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries summed in one go by ``running``: adding to an array copies it.
RUN = 256


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.transform(F.array(value), body)[0]


def running(values: Column) -> Column:
    """Sums of the first 1, 2, ... entries of an array of numbers, in two levels so
    that the work stays nearly linear for arrays of a million entries."""
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint"))
    add = lambda acc, x: F.array_append(acc, last(acc) + x)
    cut = lambda a: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / RUN).cast("int"), F.lit(0))),
        lambda k: F.aggregate(F.slice(a, k * RUN + 1, F.lit(RUN)), none, add),
    )

    def join(parts):
        upto = F.aggregate(F.transform(parts, last), none, add)
        return F.flatten(F.zip_with(parts, upto, lambda p, u: F.transform(p, lambda x: x + u - last(p))))

    return bind(values, lambda a: bind(cut(a), join))


def between(text: Column, pattern: str) -> Column:
    """Texts before, between and after the matches: one more than there are matches."""
    return F.split(text, pattern, -1)


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def offsets(gaps: Column, found: Column) -> Column:
    """Struct (start, end, text) of every match, in code points, end exclusive."""
    sizes = F.zip_with(
        F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint")
    )
    return F.zip_with(
        running(sizes), found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text"))
    )


MATCH = "array<struct<start:bigint,end:bigint,text:string>>"


def matches(text: Column, pattern: str, near: Column | None = None) -> Column:
    """Offsets of all matches; none are looked for where ``near`` is false."""
    found = offsets(between(text, pattern), matched(text, pattern))
    hit = text.rlike(pattern) if near is None else near & text.rlike(pattern)
    return F.when(hit, found).otherwise(F.array().cast(MATCH))
