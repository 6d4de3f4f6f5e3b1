"""Queries: samples, rankings, queues and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.functions import temporal as D
from chronica.operators import coverage as C
from chronica.operators import relations as R
from chronica.operators import sampling as G
from chronica.operators import scale
from chronica.operators import serving
from chronica.operators import training as M
from chronica.plans import people as P
from chronica.plans.registry import query

STRATA = ["region", "occupation", "era", "tier"]
STRATA_SQL = """
st AS (SELECT person_id, region, occupation, CAST(year(birth_date) // 10 * 10 AS INTEGER) AS era, CASE WHEN editions <= 1 THEN 'wiki1' WHEN editions <= 3 THEN 'wiki2-3' WHEN editions <= 10 THEN 'wiki4-10' ELSE 'wiki11+' END AS tier, sha256('Q' || person_id) AS h FROM persons)
"""


def _strata(t):
    return t.persons.select(
        "person_id", "region", "occupation", D.year_floor(F.year("birth_date"), 10).alias("era"), S.edition_tier(F.col("editions")).alias("tier"),
        F.sha2(F.concat(F.lit("Q"), F.col("person_id").cast("string")), 256).alias("h"),
    )


def allocation_sql(target: int, floor: int, keys=STRATA) -> str:
    """Quotas step by step; the last rounds are played out row by row."""
    k = ", ".join(keys)
    label = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in keys)
    return f"""
cnt AS (SELECT {k}, {label} AS lab, count(*) AS n, least(count(*), {floor}) AS base FROM st GROUP BY ALL),
w AS (SELECT *, sqrt((n - base)::DOUBLE) AS w, greatest({target} - (SELECT sum(base) FROM cnt), 0) AS rem FROM cnt),
r AS (SELECT *, CASE WHEN (SELECT sum(w) FROM w) > 0 THEN rem * w / (SELECT sum(w) FROM w) ELSE 0 END AS raw FROM w),
q AS (SELECT *, base + least(n - base, CAST(floor(raw) AS BIGINT)) AS q1, raw - floor(raw) AS frac FROM r),
s AS (SELECT least({target} - sum(q1), sum(n - q1)) AS spare FROM q),
l AS (SELECT lab FROM q WHERE n > q1 QUALIFY row_number() OVER (ORDER BY frac DESC, lab DESC) <= (SELECT spare FROM s)),
q2 AS (SELECT *, q1 + CASE WHEN lab IN (SELECT lab FROM l) THEN 1 ELSE 0 END AS q2 FROM q),
rest AS (SELECT greatest((SELECT spare FROM s) - (SELECT count(*) FROM l), 0) AS v),
turns AS (SELECT lab, j FROM q2, range(1, (SELECT CAST(max(n - q2) AS BIGINT) FROM q2) + 1) x(j) WHERE j <= n - q2 QUALIFY row_number() OVER (ORDER BY j, n - q2 DESC, lab) <= (SELECT v FROM rest)),
quota AS (SELECT {k}, n, CAST(q2 + (SELECT count(*) FROM turns t WHERE t.lab = q2.lab) AS BIGINT) AS quota FROM q2)
"""


@query("g01_allocation", f"WITH {STRATA_SQL}, {allocation_sql(400, 2)} SELECT region, occupation, era, tier, n, quota FROM quota", "persons")
def allocation(t):
    counts = _strata(t).groupBy(*STRATA).agg(F.count(F.lit(1)).alias("n"))
    return G.allocate(counts, STRATA, 400, 2)


@query("g01_tight_allocation", f"WITH {STRATA_SQL}, {allocation_sql(120, 0, ['region', 'tier'])} SELECT region, tier, n, quota FROM quota", "persons")
def tight_allocation(t):
    counts = _strata(t).groupBy("region", "tier").agg(F.count(F.lit(1)).alias("n"))
    return G.allocate(counts, ["region", "tier"], 120, 0)


@query(
    "g01_stratified_sample",
    f"""WITH {STRATA_SQL}, {allocation_sql(400, 2)}
SELECT person_id, st.region, st.occupation, st.era, st.tier, n AS stratum_population, quota AS stratum_sample, n / quota AS sampling_weight
FROM st JOIN quota ON st.region = quota.region AND st.occupation = quota.occupation AND st.era = quota.era AND st.tier = quota.tier
QUALIFY row_number() OVER (PARTITION BY st.region, st.occupation, st.era, st.tier ORDER BY h) <= quota""",
    "persons",
)
def stratified_sample(t):
    return G.stratified(_strata(t), STRATA, "h", 400, 2).drop("h")


@query(
    "g02_proportional_sample",
    f"""WITH {STRATA_SQL}, c AS (SELECT occupation, least(greatest(CAST(round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM st), 0) AS BIGINT), 1), count(*)) AS quota FROM st GROUP BY 1),
s AS (SELECT st.*, row_number() OVER (PARTITION BY st.occupation ORDER BY h) <= quota AS chosen FROM st JOIN c ON c.occupation = st.occupation)
SELECT person_id, occupation FROM s ORDER BY chosen DESC, h LIMIT 100""",
    "persons",
)
def proportional_sample(t):
    return G.proportional(_strata(t).select("person_id", "occupation", "h"), "occupation", "h", 100).drop("h")


@query(
    "g03_round_robin",
    f"""WITH {STRATA_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY region, occupation ORDER BY h) AS rn, sha256('20261003|' || region || '|' || occupation) AS sh FROM st)
SELECT person_id, region, occupation, CAST(rn AS INTEGER) AS round FROM r ORDER BY rn, sh LIMIT 60""",
    "persons",
)
def round_robin(t):
    rows = _strata(t).select("person_id", "region", "occupation", "h")
    return G.round_robin(rows, ["region", "occupation"], "h", 60, "20261003").drop("h")


LEVERAGE_SQL = f"""
WITH {P.THICK_SQL}, cov AS (SELECT * FROM thick WHERE snapshot = 'new'),
cand AS (SELECT c.*, p.country, p.gender, CAST(year(p.birth_date) // 10 * 10 AS INTEGER) AS decade,
  least(effective_event_points, 15) * 4 / 15 + least(domain_count, 4) * 4 / 4 + least(stage_count, 3) * 3 / 3 AS base,
  CASE WHEN coverage_tier = 'bronze' THEN 2 ELSE 0 END + CASE WHEN effective_event_points >= 10 THEN 1 ELSE 0 END + CASE WHEN domain_count >= 3 THEN 1 ELSE 0 END AS bonus FROM cov c JOIN persons p ON p.person_id = c.person_id)
"""


def _candidates(t):
    cov = C.thickness(t.raw_events)
    people = t.persons.select("person_id", "country", "gender", D.year_floor(F.year("birth_date"), 10).alias("decade"))
    return cov.join(people, "person_id")


@query(
    "g04_leverage_ranking",
    LEVERAGE_SQL
    + """, s AS (SELECT person_id, country, round(base + 2.5 + bonus, 6) AS score FROM cand WHERE source_family_count < 3), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY score DESC, person_id) AS rn FROM s)
SELECT person_id, country, score, CAST(rn AS INTEGER) AS group_rank FROM r WHERE rn <= 3 ORDER BY score DESC, person_id LIMIT 50""",
    "persons memberships",
)
def leverage_ranking(t):
    rows = _candidates(t).where(F.col("source_family_count") < 3).select("person_id", "country", F.round(G.second_source_score(), 6).alias("score"))
    return G.capped_ranking(rows, "country", "score", "person_id", 3, 50)


@query(
    "g05_diverse_ranking",
    LEVERAGE_SQL.replace("WITH", "WITH RECURSIVE", 1)
    + """, s AS (SELECT person_id, country, gender, decade, round(base + bonus + CASE WHEN stage_count >= 3 THEN 1 ELSE 0 END - greatest(effective_event_points - 30, 0) * 0.02::DOUBLE, 6) AS score FROM cand WHERE effective_event_points >= 3),
-- The loop itself: each step adds the best row that is left.
loop AS (SELECT 0 AS step, CAST([] AS STRUCT(person_id BIGINT, country VARCHAR, gender VARCHAR, decade INTEGER, score DOUBLE, group_rank INTEGER, stratum_rank INTEGER, value DOUBLE)[]) AS picked
  UNION ALL
  SELECT step + 1, list_append(any_value(picked), arg_max(pick, o)) FROM (
    SELECT step, picked, {'person_id': person_id, 'country': country, 'gender': gender, 'decade': decade, 'score': score,
        'group_rank': CAST(g + 1 AS INTEGER), 'stratum_rank': CAST(n + 1 AS INTEGER), 'value': round(score - 0.15::DOUBLE * n - 0.03::DOUBLE * g, 9)} AS pick,
      ROW(round(score - 0.15::DOUBLE * n - 0.03::DOUBLE * g, 9), score, -person_id) AS o
    FROM (SELECT step, picked, s.*, len(list_filter(picked, lambda x: x.country IS NOT DISTINCT FROM s.country)) AS g,
        len(list_filter(picked, lambda x: x.country IS NOT DISTINCT FROM s.country AND x.gender IS NOT DISTINCT FROM s.gender AND x.decade IS NOT DISTINCT FROM s.decade)) AS n
      FROM loop, s WHERE step < 80 AND NOT list_contains(list_transform(picked, lambda x: x.person_id), s.person_id)) WHERE g < 8)
  GROUP BY step)
SELECT unnest(p) FROM (SELECT unnest(picked) AS p FROM loop WHERE step = (SELECT max(step) FROM loop))""",
    "persons memberships",
)
def diverse_ranking(t):
    rows = _candidates(t).where(F.col("effective_event_points") >= 3).select(
        "person_id", "country", "gender", "decade", F.round(G.biography_score(), 6).alias("score")
    )
    return G.diverse_ranking(rows, ["country", "gender", "decade"], "country", "score", "person_id", cap=8, target=80)


@query(
    "g06_review_queue",
    """
WITH c AS (SELECT event_id, person_id, domain, sha256('q|' || event_id) AS h FROM event_rows), ppl AS (SELECT person_id FROM (SELECT DISTINCT person_id FROM c) ORDER BY sha256('20261003|' || person_id) LIMIT 100),
f AS (SELECT c.*, row_number() OVER (PARTITION BY person_id, domain ORDER BY h) AS rn FROM c WHERE person_id IN (SELECT person_id FROM ppl)),
g AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, h) AS place FROM f)
SELECT event_id, person_id, domain, CAST(place AS INTEGER) AS place FROM g WHERE place <= 4""",
    "event_rows",
)
def review_queue(t):
    rows = t.event_rows.select("event_id", "person_id", "domain", scale.hash_order(F.lit("q"), F.col("event_id")).alias("h"))
    return G.review_queue(rows, "person_id", "domain", "h", people=100, per_person=4, seed="20261003").drop("h")


@query(
    "g07_visibility_ranking",
    "SELECT person_id, visibility FROM (SELECT c_custkey AS person_id, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS visibility FROM customer) ORDER BY coalesce(visibility, 1e30), person_id LIMIT 40",
)
def visibility_ranking(t):
    rows = t.customer.select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("visibility"))
    return rows.orderBy(F.coalesce("visibility", F.lit(1e30)), "person_id").limit(40)


@query(
    "g08_group_split",
    """SELECT seed, CAST('0x' || substr(sha256('split' || seed || '|' || person_id), 1, 8) AS BIGINT) % 100 < 25 AS is_test, count(*) AS events, count(DISTINCT person_id) AS people FROM event_rows, range(0, 3) r(seed) GROUP BY 1, 2""",
    "event_rows",
)
def group_split(t):
    # The split is a function of the person, so it is drawn once per person.
    per = t.event_rows.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    draws = F.array(*[F.struct(F.lit(s).cast("bigint").alias("seed"), (M.hash_bucket(F.col("person_id"), f"split{s}") < 25).alias("is_test")) for s in range(3)])
    return per.select("n", F.inline(draws)).groupBy("seed", "is_test").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("people"))


@query(
    "g09_ordered_lookup",
    "SELECT event_id, person_id, date_min::VARCHAR AS date_min, subject_id FROM event_rows WHERE domain = 'career' AND date_min >= DATE '1999-01-01' ORDER BY subject_id ASC NULLS LAST, date_min, event_id LIMIT 200",
    "event_rows",
)
def ordered_lookup(t):
    where = (F.col("domain") == "career") & (F.col("date_min") >= F.lit("1999-01-01").cast("date"))
    rows = serving.lookup(t.event_rows, where, [F.asc_nulls_last("subject_id"), F.col("date_min"), F.col("event_id")], 200)
    return rows.select("event_id", "person_id", "date_min", "subject_id")


@query(
    "g10_capped_output",
    """WITH r AS (SELECT event_id, person_id, row_number() OVER (PARTITION BY person_id ORDER BY date_min, event_id) AS rn, count(*) OVER (PARTITION BY person_id) AS total FROM event_rows)
SELECT event_id, person_id, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 5""",
    "event_rows",
)
def capped_output(t):
    rows = t.event_rows.select("event_id", "person_id", "date_min")
    return R.capped(rows, "person_id", ["date_min", "event_id"], 5).drop("date_min")


@query(
    "g10_truncated_people",
    "SELECT count(*) FILTER (WHERE n > 5) AS truncated_people, CAST(sum(greatest(n - 5, 0)) AS BIGINT) AS rows_beyond FROM (SELECT person_id, count(*) AS n FROM event_rows GROUP BY 1)",
    "event_rows",
)
def truncated_people(t):
    per = t.event_rows.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_if(F.col("n") > 5).alias("truncated_people"), F.sum(F.greatest(F.col("n") - 5, F.lit(0))).alias("rows_beyond"))
