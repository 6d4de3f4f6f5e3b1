"""Biography text to candidate sentences and rule events.

Texts are processed whole. A document explodes into sentences in its own row;
sentences then flow independently, so a very long text is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.functions.markup import unescaped, without_nested

UNICODE = "(?U)"


# --- prose ------------------------------------------------------------------
def html_prose(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and navigation dropped,
    cut at the first tail heading, tags removed, entities decoded."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?is)<(script|style|nav|head|footer|aside)\b.*?</\1\s*>", " ")
    titles = "|".join(vocab.TAIL_SECTIONS)
    bare = F.regexp_replace(bare, rf"(?isU)<h[1-6][^>]*>(?:\s|<[^>]*>)*(?:{titles})(?:\s|<[^>]*>)*</h[1-6]>.*", " ")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    return clean(unescaped(text))


def wiki_prose(wikitext: Column) -> Column:
    """Plain prose of wiki markup: references, galleries, templates and tables dropped,
    cut at the first tail heading, links and emphasis reduced to their text, bare
    links dropped, entities decoded."""
    bare = F.regexp_replace(F.coalesce(wikitext, F.lit("")), r"(?is)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)<(ref|references|gallery|math|timeline)\b[^>]*?/>", "")
    bare = F.regexp_replace(bare, r"(?is)<(ref|references|gallery|math|timeline)\b[^>]*>.*?</\1\s*>", "")
    bare = without_nested(without_nested(bare, "{{", "}}"), "{|", "|}")
    titles = "|".join(vocab.TAIL_SECTIONS)
    bare = F.regexp_replace(bare, rf"(?isU)(?:^|\n)[ \t]*(=+)\s*(?:{titles})\s*\1[ \t]*(?:\n.*|$)", "")
    bare = F.regexp_replace(bare, r"(?m)^[ \t]*=+\s*(.*?)\s*=+[ \t]*$", "$1")
    bare = F.regexp_replace(bare, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    bare = F.regexp_replace(bare, r"\[https?://[^\s\]]+\s+([^\]]*)\]", "$1")
    bare = F.regexp_replace(bare, r"\[https?://[^\s\]]+\s*\]", "")
    bare = F.regexp_replace(bare, r"'{2,}", "")
    return F.trim(unescaped(F.regexp_replace(bare, r"(?s)<[^>]*>", "")))


def clean(text: Column) -> Column:
    """Runs of white space, in any script, to one blank."""
    return F.trim(F.regexp_replace(text, rf"{UNICODE}\s+", " "))


# --- sentences --------------------------------------------------------------
def sentences(docs: DataFrame, text: str, pattern: str = vocab.SENTENCE_PATTERN) -> DataFrame:
    """One row per non-empty sentence with its place ``i`` in the text."""
    parts = F.filter(F.transform(F.split(text, UNICODE + pattern), clean), lambda s: s != "")
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(parts).alias("i", "sentence"))


def found(text: Column, pattern: str) -> Column:
    """All matches; the group's text where the pattern has one."""
    group = 1 if "(" in pattern.replace("(?", "") else 0
    return F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(group))


_SPECIAL = set(".^$*+?{}[]\\|()")


def _plain(pattern: str) -> bool:
    return not set(pattern) & _SPECIAL


def _hits(lowered: str, patterns) -> list[Column]:
    """One test per pattern on lower-cased text. Plain words are searched as
    substrings, which is many times cheaper than a regular expression."""
    text = F.col(lowered)
    return [text.contains(p.lower()) if _plain(p) else text.rlike(f"(?iu){p}") for p in patterns]


def with_lowered(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("lowered", F.lower(text))


def domain_scores(lowered: str, keywords=vocab.KEYWORDS) -> dict[str, Column]:
    """How many of a domain's patterns occur."""
    return {d: sum((h.cast("int") for h in _hits(lowered, ps)), F.lit(0)) for d, ps in keywords.items()}


def domains_hit(lowered: str, keywords=vocab.KEYWORDS) -> Column:
    """Domains with any hit; the first hit of a domain ends its search."""
    out = []
    for domain, patterns in keywords.items():
        simple = [p for p in patterns if _plain(p)]
        other = [p for p in patterns if not _plain(p)]
        tests = _hits(lowered, simple) + ([F.col(lowered).rlike("(?iu)" + "|".join(f"(?:{p})" for p in other))] if other else [])
        hit = tests[0]
        for test in tests[1:]:
            hit = hit | test
        out.append(F.when(hit, F.lit(domain)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def candidates(docs: DataFrame, text: str, year_pattern: str = vocab.YEAR_PATTERN, age_patterns=(vocab.AGE_EN_PATTERN, vocab.AGE_ZH_PATTERN), keywords=vocab.KEYWORDS) -> DataFrame:
    """Sentences with a year or age and at least one domain. Long ones are clipped
    around their first marker; years and ages are those of the whole sentence.

    The marker test comes first: it is one pattern and drops most sentences
    before the keyword patterns run.
    """
    markers = [year_pattern, *[f"(?i){p}" for p in age_patterns]]
    rows = sentences(docs, text)
    anything = "|".join(f"(?:{p})" for p in (year_pattern, *age_patterns))
    marked = rows.where(F.col("sentence").rlike(f"(?iU){anything}"))
    read = with_lowered(marked, "sentence").withColumns(
        {
            "years": found(F.col("sentence"), year_pattern),
            "ages": F.concat(F.array().cast("array<string>"), *[found(F.col("sentence"), f"(?i){p}") for p in age_patterns]),
            "domains": domains_hit("lowered", keywords),
        }
    ).where(F.size("domains") > 0)
    starts = [F.nullif(F.regexp_instr("sentence", F.lit(UNICODE + m)), F.lit(0)) for m in markers]
    pivot = (F.least(*starts) if len(starts) > 1 else starts[0]) - 1
    begin = F.greatest(pivot - vocab.CLIP_BEFORE, F.lit(0))
    clipped = F.substring(F.col("sentence"), begin + 1, pivot + vocab.CLIP_AFTER - begin)
    return read.withColumn("text", F.when(F.length("sentence") > vocab.CLIP_LIMIT, clipped).otherwise(F.col("sentence"))).drop("sentence", "lowered")


def rule_events(rows: DataFrame, triggers=vocab.TRIGGERS) -> DataFrame:
    """Candidates with one distinct year and one domain whose text meets a
    trigger of that domain, first trigger first, as year events."""
    single = (F.size(F.array_distinct("years")) == 1) & (F.size(F.array_distinct("domains")) == 1)
    domain = F.get("domains", F.lit(0))
    kind = F.lit(None).cast("string")
    for name, patterns in reversed(triggers):
        hit = (F.col("domain") == name.split(".", 1)[0]) & F.col("text").rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))
        kind = F.when(hit, name).otherwise(kind)
    typed = rows.where(single).withColumn("domain", domain).withColumn("event_type", kind).where(F.col("event_type").isNotNull())
    year = F.lpad(F.get("years", F.lit(0)), 4, "0")
    dated = typed.withColumns(
        {
            "date_min": F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd"),
            "date_max": F.try_to_date(F.concat(year, F.lit("-12-31")), "yyyy-MM-dd"),
        }
    ).where(F.col("date_min").isNotNull())
    return dated.withColumns(
        {
            "precision": F.lit("year"),
            "confidence": F.lit(vocab.RULE_EVENT_CONFIDENCE),
            "observable_from": F.col("date_max"),
            "extraction_method": F.lit("rule-from-revision-text"),
        }
    )


def with_midyear_age(events: DataFrame, births: DataFrame) -> DataFrame:
    joined = events.join(births.select("person_id", "birth_date"), "person_id", "left")
    return joined.withColumn("age_mid", D.midyear_age(F.col("birth_date"), F.year("date_min")))


def extraction_quality(extracted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Precision against adjudicated rows, and accuracy of domain, date and
    identity among the accepted ones."""
    joined = extracted.join(gold, key)
    ok = F.col("accepted")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return joined.agg(
        F.count(F.lit(1)).alias("adjudicated"),
        F.count_if(ok).alias("accepted_rows"),
        rate(F.count_if(ok), F.count(F.lit(1))).alias("event_precision"),
        *[rate(F.count_if(ok & F.col(f"{n}_ok")), F.count_if(ok)).alias(f"{n}_accuracy") for n in ("domain", "date", "identity")],
    )
