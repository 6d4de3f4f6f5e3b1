"""Queries: biography text over the documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica.functions import vocab
from chronica.operators import text as T
from chronica.plans.registry import query

# The documents are invented prose: syllables of theirs stand in for keywords,
# and any run of digits for a year.
SYLLABLES = {
    "career": ("heon", "tionh"),
    "creation": ("eaux", "mente?l"),
    "education": ("sch.*ver", "ados"),
    "relationship": ("thwh", "ciona"),
}
# For rule events a sentence must fall into one domain only.
DISJOINT = {"career": ("on", "an", "er"), "setback": ("token", "@")}
DISJOINT_TRIGGERS = (
    ("career.appointment", ("heon.*th", "nde")),
    ("career.role_start", ("on",)),
    ("setback.job_loss", ("token",)),
)

SENTENCES_SQL = r"""
parts AS (SELECT doc_id, source, string_split(regexp_replace(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS p FROM documents),
sent AS (SELECT doc_id, source, CAST(unnest(range(0, len(s))) AS INTEGER) AS i, unnest(s) AS sentence FROM (
  SELECT doc_id, source, list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS s FROM parts))
"""


@query("t01_wiki_prose", "SELECT doc_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' Named link.' AS t FROM documents)")
def wiki_prose(t):
    markup = F.concat(
        F.lit("{{Infobox person|name={{lang|en|{{nowrap|X}}}}|born=1970}}"),
        F.col("text"),
        F.lit("<ref name=a>{{cite|year=2004}}</ref>\n'''Named''' [[Target|link]].{{End}}\n== References ==\n* In 2004 she graduated.\n"),
    )
    prose = T.clean(T.wiki_prose(markup))
    return t.documents.select("doc_id", prose.alias("prose")).select("doc_id", F.length("prose").alias("chars"), F.sha2("prose", 256).alias("digest"))


def _html_sql():
    """Elements by one alternation (no back references here), the entities that pages hold
    one after the other with the ampersand last, so that none is read twice."""
    gone = "|".join(rf"<{n}\b.*?</{n}\s*>" for n in ("script", "style", "nav", "head", "footer", "aside"))
    blank = r"(?:\s|<[^>]*>)*"
    tail = rf"<h[1-6][^>]*>{blank}(?:{'|'.join(vocab.TAIL_SECTIONS)}){blank}</h[1-6]>.*"
    out = "coalesce(html, '')"
    for pattern in (r"(?s)<!--.*?-->", f"(?is){gone}", f"(?is){tail}", r"(?s)<[^>]*>"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("middot", "·"), ("copy", "©"), ("nbsp", "\u00a0")):
        out = f"regexp_replace({out}, '&{name};?', '{char}', 'g')"
    out = rf"trim(regexp_replace(regexp_replace({out}, '&amp;?', '&', 'g'), '[\s\x{{0b}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"
    return f"""SELECT page_id, length(p) AS chars, sha256(p) AS digest, regexp_matches(p, '</?(script|style|nav)') AS markup_left
FROM (SELECT page_id, {out} AS p FROM pages)"""


@query("t01_html_prose", _html_sql())
def html_prose(t):
    """Visible text of every page, in figures."""
    prose = t.pages.select("page_id", T.html_prose(F.col("html")).alias("prose"))
    return prose.select(
        "page_id", F.length("prose").alias("chars"), F.sha2("prose", 256).alias("digest"), F.col("prose").rlike(r"</?(script|style|nav)").alias("markup_left")
    )


@query(
    "t02_sentences",
    f"WITH {SENTENCES_SQL} SELECT doc_id, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars, max(i) AS last_i FROM sent GROUP BY 1",
)
def sentences(t):
    rows = T.sentences(t.documents.select("doc_id", "text"), "text")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence").cast("bigint")).alias("chars"), F.max("i").alias("last_i")
    )


@query(
    "t03_markers",
    f"""WITH {SENTENCES_SQL} SELECT doc_id, i, array_to_string(regexp_extract_all(sentence, '[0-9]+'), '|') AS numbers, CAST(len(regexp_extract_all(sentence, '\\b(?:1[0-9][0-9][0-9]|20[0-9][0-9])\\b')) AS INTEGER) AS years FROM sent WHERE regexp_matches(sentence, '[0-9]')""",
)
def markers(t):
    rows = T.sentences(t.documents.select("doc_id", "text"), "text").where(F.col("sentence").rlike("[0-9]"))
    return rows.select("doc_id", "i", T.found(F.col("sentence"), "[0-9]+").alias("numbers"), F.size(T.found(F.col("sentence"), vocab.YEAR_PATTERN)).alias("years"))


def _score_sql(text, keywords):
    return {d: " + ".join(f"regexp_matches({text}, '{p}', 'i')::INT" for p in ps) for d, ps in keywords.items()}


@query(
    "t04_domain_scores",
    f"WITH {SENTENCES_SQL} SELECT source, "
    + ", ".join(f"CAST(sum({s}) AS BIGINT) AS score_{d}" for d, s in _score_sql("sentence", vocab.KEYWORDS).items())
    + ", "
    + ", ".join(f"CAST(sum({s}) AS BIGINT) AS syllable_{d}" for d, s in _score_sql("sentence", SYLLABLES).items())
    + " FROM sent GROUP BY 1",
)
def domain_scores(t):
    rows = T.with_lowered(T.sentences(t.documents.select("doc_id", "source", "text"), "text"), "sentence")
    real, invented = T.domain_scores("lowered"), T.domain_scores("lowered", SYLLABLES)
    return rows.groupBy("source").agg(
        *[F.sum(c).alias(f"score_{d}") for d, c in real.items()], *[F.sum(c).alias(f"syllable_{d}") for d, c in invented.items()]
    )


def _candidates_sql(marker, keywords=SYLLABLES):
    hits = ", ".join(f"CASE WHEN regexp_matches(sentence, '{'|'.join(ps)}', 'i') THEN '{d}' END" for d, ps in keywords.items())
    return f"""{SENTENCES_SQL},
mk AS (SELECT *, regexp_extract_all(sentence, '{marker}') AS years, list_filter([{hits}], lambda x: x IS NOT NULL) AS domains, length(sentence) - length(regexp_replace(sentence, '^(?s:.*?)({marker})', '\\1')) AS pv FROM sent WHERE regexp_matches(sentence, '{marker}')),
cand AS (SELECT doc_id, source, i, years, domains, CASE WHEN length(sentence) > 700 THEN substr(sentence, CAST(greatest(pv - 250, 0) + 1 AS BIGINT), CAST(pv + 450 - greatest(pv - 250, 0) AS BIGINT)) ELSE sentence END AS text FROM mk WHERE len(domains) > 0)"""


def _candidates(t, marker, keywords=SYLLABLES):
    return T.candidates(t.documents.select("doc_id", "source", "text"), "text", year_pattern=marker, age_patterns=(), keywords=keywords)


@query(
    "t05_candidates",
    f"WITH {_candidates_sql('[0-9]+')} SELECT doc_id || ':' || source || ':' || i AS candidate_id, array_to_string(years, '|') AS years, array_to_string(domains, '|') AS domains, length(text) AS text_length, sha256(text) AS digest FROM cand",
)
def candidates(t):
    return _candidates(t, "[0-9]+").select(
        F.concat_ws(":", F.col("doc_id").cast("string"), "source", F.col("i").cast("string")).alias("candidate_id"),
        "years", "domains", F.length("text").alias("text_length"), F.sha2("text", 256).alias("digest"),
    )


def _trigger_sql():
    arms = " ".join(f"WHEN domains[1] = '{n.split('.')[0]}' AND regexp_matches(text, '{'|'.join(ps)}', 'i') THEN '{n}'" for n, ps in DISJOINT_TRIGGERS)
    return f"CASE {arms} END"


RULE_SQL = f"""{_candidates_sql('[0-9][0-9][0-9][0-9]', DISJOINT)},
rules AS (SELECT *, {_trigger_sql()} AS event_type, TRY_CAST(years[1] || '-01-01' AS DATE) AS lo, TRY_CAST(years[1] || '-12-31' AS DATE) AS hi FROM cand WHERE len(list_distinct(years)) = 1 AND len(domains) = 1)"""


@query(
    "t06_rule_events",
    f"WITH {RULE_SQL} SELECT 'bio:' || doc_id || ':' || i AS event_id, split_part(event_type, '.', 1) AS domain, event_type, lo::VARCHAR AS date_min, hi::VARCHAR AS date_max, 0.82::DOUBLE AS confidence FROM rules WHERE event_type IS NOT NULL AND lo IS NOT NULL AND years[1] <> '0000'",
)
def rule_events(t):
    rows = T.rule_events(_candidates(t, "[0-9][0-9][0-9][0-9]", DISJOINT), DISJOINT_TRIGGERS)
    return rows.select(
        F.concat_ws(":", F.lit("bio"), F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("event_id"),
        "domain", "event_type", "date_min", "date_max", "confidence",
    )


@query(
    "t07_extraction_quality",
    f"""WITH {_candidates_sql('[0-9]+')}, j AS (SELECT c.doc_id, quality = 1 AS ok, len(domains) = 1 AS d_ok, len(years) = 1 AS y_ok, toxic = 0 AS i_ok FROM cand c JOIN labels l ON l.doc_id = c.doc_id)
SELECT count(*) AS adjudicated, count(*) FILTER (WHERE ok) AS accepted_rows, coalesce(round(count(*) FILTER (WHERE ok) / nullif(count(*), 0), 9), 0.0) AS event_precision, coalesce(round(count(*) FILTER (WHERE ok AND d_ok) / nullif(count(*) FILTER (WHERE ok), 0), 9), 0.0) AS domain_accuracy,
  coalesce(round(count(*) FILTER (WHERE ok AND y_ok) / nullif(count(*) FILTER (WHERE ok), 0), 9), 0.0) AS date_accuracy, coalesce(round(count(*) FILTER (WHERE ok AND i_ok) / nullif(count(*) FILTER (WHERE ok), 0), 9), 0.0) AS identity_accuracy FROM j""",
)
def extraction_quality(t):
    rows = _candidates(t, "[0-9]+").select("doc_id", (F.size("domains") == 1).alias("domain_ok"), (F.size("years") == 1).alias("date_ok"))
    gold = t.labels.select("doc_id", (F.col("quality") == 1).alias("accepted"), (F.col("toxic") == 0).alias("identity_ok"))
    out = T.extraction_quality(rows, gold, "doc_id")
    return out.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])
