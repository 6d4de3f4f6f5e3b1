"""Brackets and entities in column expressions against plain Python."""

import html
import random

from pyspark.sql import functions as F

from chronica.functions import markup as K
from chronica.operators import text as T


def by_hand(text, start, end):
    """A pair goes, innermost first, until none is left."""
    out, opened, at = [], [], 0
    while at < len(text):
        two = text[at : at + 2]
        if two == end and opened:
            del out[opened.pop() :]
            at += 2
            continue
        if two in (start, end):
            if two == start:
                opened.append(len(out))
            out.append(two)
            at += 2
            continue
        out.append(text[at])
        at += 1
    return "".join(out)


def test_nested_brackets_against_a_stack(spark):
    rng = random.Random(4)
    parts = ["{{", "}}", "{", "}", "{|", "|}", "a", "é\n", " ", "|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 90))) for _ in range(400)]
    texts += ["x" + "{{" * 50 + "deep" + "}}" * 50 + "y", "{{" * 50 + "z" + "}}" * 49, "{{a" * 3000 + "}}" * 2990 + "tail", "", "}}{{", "{{}}"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for start, end in (("{{", "}}"), ("{|", "|}")):
        got = {r.k: r.out for r in df.select("k", K.without_nested(F.col("t"), start, end).alias("out")).collect()}
        assert got == {k: by_hand(t, start, end) for k, t in enumerate(texts)}
    assert spark.range(1).select(K.without_nested(F.lit(None).cast("string"), "{{", "}}").alias("out")).first().out is None


def test_entities_against_the_standard_library(spark):
    rng = random.Random(5)
    names = sorted(html.entities.html5)
    numbers = [*range(0, 300), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0xFFFF, 0x1F600, 0x10FFFF, 0x110000, 10**12]
    texts = [f"a&{n} b&{n}x&{n.rstrip(';')};" for n in names]
    texts += [f"&#{n};&#{n} &#x{n:x};&#X{n:X}z&#000{n};" for n in numbers]
    pieces = ["&", "&amp;", "&amp", "&notit;", "&lt", "#", ";", "&#", "&#x", "&#x;", "&;", "&unknown;", " ", "é", "&&", "&nbsp;", "&#38;", "q"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4)
    got = {r.k: r.out for r in df.select("k", K.unescaped(F.col("t")).alias("out")).collect()}
    wrong = [(t, got[k], html.unescape(t)) for k, t in enumerate(texts) if got[k] != html.unescape(t)]
    assert not wrong, wrong[:5]


def test_prose_plans_no_python_worker(spark):
    rows = spark.range(1).select(F.concat(F.lit("{{a|{{b}}}}Text &amp; more{| t |}"), F.when(F.col("id") > 0, "x").otherwise("")).alias("t"))
    wiki, page = rows.select(T.wiki_prose(F.col("t")).alias("p")), rows.select(T.html_prose(F.col("t")).alias("p"))
    for df in (wiki, page):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Project" in plan and "EvalPython" not in plan
    assert wiki.first().p == "Text & more"
