"""Queries: annual states, sequences and surrogate keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica.functions import vocab
from chronica.operators import scale
from chronica.operators import states as Y
from chronica.operators import training
from chronica.plans import people as P
from chronica.plans.registry import query

FAMILY = f"""CASE fam WHEN 'relationship.marriage' THEN 'relationship.start' WHEN 'relationship.divorce' THEN 'relationship.end' WHEN 'education.complete' THEN 'education.end' ELSE fam END"""
HF = "('creation.scholar_output', 'creation.music_output', 'performance.event')"

BASE_SQL = f"""
ev AS (SELECT *, {FAMILY} AS family, year(observable_from) AS y FROM (SELECT *, event_family AS fam FROM raw_events)),
eff AS (SELECT * FROM ev QUALIFY family NOT IN {HF} OR row_number() OVER (PARTITION BY person_id, y, family ORDER BY date_min, event_id) = 1),
grid AS (SELECT person_id, CAST(unnest(range(min(y), max(y) + 1)) AS INTEGER) AS year FROM ev GROUP BY 1)
"""


def _agg(select: str, source: str, on: str) -> str:
    return f"(SELECT g.person_id, g.year, {select} FROM grid g LEFT JOIN {source} e ON e.person_id = g.person_id AND {on} GROUP BY 1, 2)"


def _entropy_sql(source: str, item: str, on: str) -> str:
    return f"""(SELECT g.person_id, g.year, round(greatest(coalesce(-sum(CASE WHEN c > 0 THEN c / t * ln(c / t) END), 0), 0), 6) + 0.0 AS v FROM grid g LEFT JOIN (
  SELECT person_id, year, c, sum(c) OVER (PARTITION BY person_id, year) AS t FROM (
    SELECT g.person_id, g.year, e.{item}, count(*)::DOUBLE AS c FROM grid g JOIN {source} e ON e.person_id = g.person_id AND {on} GROUP BY 1, 2, 3)) x ON x.person_id = g.person_id AND x.year = g.year GROUP BY 1, 2)"""


def year_states_sql() -> str:
    now, upto = "e.y = g.year", "e.y <= g.year"

    def last(n):
        return f"e.y BETWEEN g.year - {n - 1} AND g.year"

    domains = vocab.DOMAINS
    parts = {
        "a": _agg("count(e.event_id) AS events_this_year, count(DISTINCT domain) AS domains_this_year, count(DISTINCT source_family) AS source_families_this_year, "
                  + ", ".join(f"count(*) FILTER (WHERE domain = '{d}') AS year_count__{d}" for d in domains), "ev", now),
        "b": _agg("count(e.event_id) AS effective_points_this_year, count(DISTINCT domain) AS effective_domains_this_year, "
                  + ", ".join(f"count(*) FILTER (WHERE domain = '{d}') AS effective_year_count__{d}" for d in domains), "eff", now),
        "c": _agg("count(e.event_id) AS cumulative_events, count(DISTINCT source_family) AS cumulative_source_family_breadth, g.year - max(e.y) AS years_since_last_event, "
                  "count(*) FILTER (WHERE family IN ('career.role_start', 'career.role_end')) AS career_transitions_cumulative, count(*) FILTER (WHERE family = 'migration.move') AS migration_transitions_cumulative, "
                  "count(*) FILTER (WHERE family IN ('relationship.start', 'relationship.end')) AS relationship_transitions_cumulative", "ev", upto),
        "d": _agg("count(e.event_id) AS cumulative_effective_points, count(DISTINCT domain) AS cumulative_domain_breadth, "
                  + ", ".join(f"g.year - max(e.y) FILTER (WHERE domain = '{d}') AS years_since_last_{d}" for d in ("career", "migration", "creation", "recognition"))
                  + ", " + ", ".join(f"count(*) FILTER (WHERE domain = '{d}') AS cum_effective__{d}" for d in domains), "eff", upto),
        "e3": _agg("count(e.event_id) AS rolling_3y_events", "ev", last(3)),
        "f3": _agg("count(e.event_id) AS rolling_3y_effective_points, count(*) FILTER (WHERE domain = 'creation') AS c3", "eff", last(3)),
        "p3": _agg("count(*) FILTER (WHERE domain = 'creation') AS c3p", "eff", "e.y BETWEEN g.year - 5 AND g.year - 3"),
        "f5": _agg("count(e.event_id) AS rolling_5y_effective_points, count(DISTINCT domain) AS rolling_5y_domain_breadth, count(*) FILTER (WHERE domain = 'recognition') AS recognition_rolling_5y, count(*) FILTER (WHERE domain = 'migration') AS migration_rolling_5y", "eff", last(5)),
    }
    select = [
        "g.person_id", "g.year", "events_this_year", "effective_points_this_year", "cumulative_events", "cumulative_effective_points", "domains_this_year", "effective_domains_this_year",
        "cumulative_domain_breadth", "h.v AS cumulative_domain_entropy", "source_families_this_year", "cumulative_source_family_breadth", "rolling_3y_events", "rolling_3y_effective_points",
        "rolling_5y_effective_points", "rolling_5y_domain_breadth", "h5.v AS event_family_entropy_5y", "c3 - c3p AS creation_momentum_3y", "recognition_rolling_5y", "migration_rolling_5y",
        "career_transitions_cumulative", "migration_transitions_cumulative", "relationship_transitions_cumulative",
        "coalesce(act.career, 0) AS active_career_roles", "coalesce(act.education, 0) AS active_education_affiliations", "coalesce(act.relationship, 0) AS active_relationships",
        *[f"CAST(years_since_last_{d} AS INTEGER) AS years_since_last_{d}" for d in ("event", "career", "migration", "creation", "recognition")],
        "coalesce(sw.n, 0) AS event_type_switches_cumulative",
        *[f"{p}__{d}" for p in ("year_count", "effective_year_count", "cum_effective") for d in domains],
    ]
    joins = " ".join(f"JOIN {sql} {name} ON {name}.person_id = g.person_id AND {name}.year = g.year" for name, sql in parts.items())
    return f"""
WITH {BASE_SQL},
role AS (SELECT person_id, split_part(family, '.', 1) AS kind, subject_id, y, date_min, event_id, family LIKE '%start' AS held FROM ev
  WHERE family IN ('career.role_start', 'career.role_end', 'education.start', 'education.end', 'relationship.start', 'relationship.end') AND subject_id IS NOT NULL),
state AS (SELECT g.person_id, g.year, r.kind, r.subject_id, arg_max(held, (date_min, event_id)) AS unsorted, last(held ORDER BY y, date_min, event_id) AS held FROM grid g JOIN role r ON r.person_id = g.person_id AND r.y <= g.year GROUP BY 1, 2, 3, 4),
act AS (SELECT person_id, year, count(*) FILTER (WHERE held AND kind = 'career') AS career, count(*) FILTER (WHERE held AND kind = 'education') AS education, count(*) FILTER (WHERE held AND kind = 'relationship') AS relationship FROM state GROUP BY 1, 2),
steps AS (SELECT person_id, y, lag(family) OVER (PARTITION BY person_id ORDER BY y, date_min, event_id) <> family AS switched FROM eff),
sw AS (SELECT g.person_id, g.year, count(*) FILTER (WHERE switched) AS n FROM grid g JOIN steps s ON s.person_id = g.person_id AND s.y <= g.year GROUP BY 1, 2)
SELECT {', '.join(select)}
FROM grid g {joins}
JOIN {_entropy_sql('eff', 'domain', upto)} h ON h.person_id = g.person_id AND h.year = g.year
JOIN {_entropy_sql('eff', 'family', last(5))} h5 ON h5.person_id = g.person_id AND h5.year = g.year
LEFT JOIN act ON act.person_id = g.person_id AND act.year = g.year LEFT JOIN sw ON sw.person_id = g.person_id AND sw.year = g.year"""


@query("f01_year_grid", f"WITH {BASE_SQL} SELECT person_id, year FROM grid", "raw_events")
def year_grid(t):
    years = Y.event_year(t.event_rows.withColumn("observable_from", F.col("date_max")))
    return Y.year_grid(years)


@query(
    "f02_high_frequency_collapse",
    f"WITH {BASE_SQL} SELECT person_id, CAST(y AS INTEGER) AS year, family, count(*) AS eff FROM eff GROUP BY 1, 2, 3",
    "raw_events",
)
def high_frequency_collapse(t):
    rows = Y.with_state_family(Y.event_year(t.raw_events))
    return Y.yearly_families(rows).groupBy("person_id", "year", "family").agg(F.sum("eff").alias("eff"))


@query("f03_year_states", year_states_sql(), "raw_events")
def year_states(t):
    return t.year_states


def _window_sql(select, on, source="eff"):
    return f"WITH {BASE_SQL} SELECT g.person_id, g.year, {select} FROM grid g LEFT JOIN {source} e ON e.person_id = g.person_id AND {on} GROUP BY 1, 2"


@query(
    "f04_rolling_windows",
    _window_sql("count(e.event_id) FILTER (WHERE e.y >= g.year - 2) AS rolling_3y_effective_points, count(e.event_id) AS rolling_5y_effective_points, count(DISTINCT domain) AS rolling_5y_domain_breadth", "e.y BETWEEN g.year - 4 AND g.year"),
    "raw_events",
)
def rolling_windows(t):
    return t.year_states.select("person_id", "year", "rolling_3y_effective_points", "rolling_5y_effective_points", "rolling_5y_domain_breadth")


@query(
    "f05_creation_momentum",
    _window_sql("count(*) FILTER (WHERE domain = 'creation' AND e.y >= g.year - 2) - count(*) FILTER (WHERE domain = 'creation' AND e.y < g.year - 2) AS creation_momentum_3y", "e.y BETWEEN g.year - 5 AND g.year"),
    "raw_events",
)
def creation_momentum(t):
    return t.year_states.select("person_id", "year", "creation_momentum_3y")


@query(
    "f06_transition_counters",
    _window_sql(
        "count(*) FILTER (WHERE family IN ('career.role_start', 'career.role_end')) AS career_transitions_cumulative, count(*) FILTER (WHERE family = 'migration.move') AS migration_transitions_cumulative, count(*) FILTER (WHERE family IN ('relationship.start', 'relationship.end')) AS relationship_transitions_cumulative",
        "e.y <= g.year", "ev",
    ),
    "raw_events",
)
def transition_counters(t):
    return t.year_states.select("person_id", "year", *[f"{n}_cumulative" for n in Y.TRANSITIONS])


@query(
    "f08_years_since",
    _window_sql("CAST(g.year - max(e.y) AS INTEGER) AS years_since_last_event, " + ", ".join(f"CAST(g.year - max(e.y) FILTER (WHERE domain = '{d}') AS INTEGER) AS years_since_last_{d}" for d in ("career", "migration", "creation", "recognition")), "e.y <= g.year"),
    "raw_events",
)
def years_since(t):
    return t.year_states.select("person_id", "year", *[f"years_since_last_{d}" for d in ("event", "career", "migration", "creation", "recognition")])


@query(
    "f10_source_breadth",
    _window_sql("count(DISTINCT source_family) FILTER (WHERE e.y = g.year) AS source_families_this_year, count(DISTINCT source_family) AS cumulative_source_family_breadth", "e.y <= g.year", "ev"),
    "raw_events",
)
def source_breadth(t):
    return t.year_states.select("person_id", "year", "source_families_this_year", "cumulative_source_family_breadth")


@query(
    "f07_active_roles",
    f"""
WITH {BASE_SQL},
r AS (SELECT person_id, split_part(family, '.', 1) AS kind, subject_id, y, last(family LIKE '%start' ORDER BY date_min, event_id) AS held FROM ev
  WHERE family IN ('career.role_start', 'career.role_end', 'education.start', 'education.end', 'relationship.start', 'relationship.end') AND subject_id IS NOT NULL GROUP BY 1, 2, 3, 4),
c AS (SELECT *, CAST(held AS INTEGER) - coalesce(CAST(lag(held) OVER (PARTITION BY person_id, kind, subject_id ORDER BY y) AS INTEGER), 0) AS change FROM r)
SELECT person_id, kind, subject_id AS subject, CAST(y AS INTEGER) AS year, change FROM c WHERE change <> 0""",
    "raw_events",
)
def active_roles(t):
    rows = Y.with_state_family(Y.event_year(t.raw_events))
    return Y.active_changes(rows).select("person_id", "kind", "subject", "year", "change")


@query(
    "f09_family_switches",
    f"""WITH {BASE_SQL}, s AS (SELECT person_id, y, lag(family) OVER (PARTITION BY person_id ORDER BY y, date_min, event_id) AS prev, family FROM eff)
SELECT person_id, CAST(y AS INTEGER) AS year, count(*) FILTER (WHERE prev <> family) AS n FROM s GROUP BY 1, 2""",
    "raw_events",
)
def family_switches(t):
    rows = Y.with_state_family(Y.event_year(t.raw_events))
    return Y.switches(rows, Y.yearly_families(rows))


@query(
    "f11_academic_states",
    """
WITH g AS (SELECT person_id, CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM outputs GROUP BY 1),
b AS (SELECT person_id, year, count(*) AS works_count, count(*) FILTER (WHERE is_first) AS first_author_count, count(*) FILTER (WHERE is_corresponding) AS corresponding_count,
  count(DISTINCT institution_id) AS unique_institutions, CAST(count(DISTINCT institution_country) AS INTEGER) AS unique_institution_countries, count(DISTINCT field_id) AS unique_fields FROM outputs GROUP BY 1, 2),
f AS (SELECT person_id, year, field_id, count(*) AS n, min((order_no, line_no)) AS at1 FROM outputs GROUP BY 1, 2, 3),
i AS (SELECT person_id, year, institution_id, count(*) AS n, min((order_no, line_no)) AS at1 FROM outputs GROUP BY 1, 2, 3),
df AS (SELECT person_id, year, field_id FROM f QUALIFY row_number() OVER (PARTITION BY person_id, year ORDER BY n DESC, at1, field_id) = 1),
di AS (SELECT person_id, year, institution_id FROM i QUALIFY row_number() OVER (PARTITION BY person_id, year ORDER BY n DESC, at1, institution_id) = 1),
h AS (SELECT person_id, year, round(greatest(-sum(n / t * ln(n / t)), 0), 6) + 0.0 AS field_entropy FROM (SELECT *, sum(n) OVER (PARTITION BY person_id, year)::DOUBLE AS t FROM f) GROUP BY 1, 2),
j AS (SELECT g.person_id, g.year, coalesce(works_count, 0) AS works_count, coalesce(first_author_count, 0) AS first_author_count, coalesce(corresponding_count, 0) AS corresponding_count,
  coalesce(unique_institutions, 0) AS unique_institutions, coalesce(unique_institution_countries, 0) AS unique_institution_countries, coalesce(unique_fields, 0) AS unique_fields, coalesce(field_entropy, 0.0) AS field_entropy,
  df.field_id AS dominant_field_id, di.institution_id AS dominant_institution_id
  FROM g LEFT JOIN b USING (person_id, year) LEFT JOIN h USING (person_id, year) LEFT JOIN df USING (person_id, year) LEFT JOIN di USING (person_id, year)),
k AS (SELECT *, last_value(dominant_field_id IGNORE NULLS) OVER w AS pf, last_value(dominant_institution_id IGNORE NULLS) OVER w AS pi,
  CAST(sum(works_count) OVER (PARTITION BY person_id ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_3y_works,
  CAST(sum(works_count) OVER (PARTITION BY person_id ORDER BY year) AS BIGINT) AS cumulative_works FROM j
  WINDOW w AS (PARTITION BY person_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT * EXCLUDE (pf, pi), coalesce(CAST(pf <> dominant_field_id AS INTEGER), 0) AS field_switch, coalesce(CAST(pi <> dominant_institution_id AS INTEGER), 0) AS institution_switch,
  (SELECT count(DISTINCT field_id) FROM outputs o WHERE o.person_id = k.person_id AND o.year <= k.year) AS cumulative_unique_fields,
  (SELECT count(DISTINCT institution_id) FROM outputs o WHERE o.person_id = k.person_id AND o.year <= k.year) AS cumulative_unique_institutions
FROM k""",
    "outputs",
)
def academic_states(t):
    works = t.outputs.withColumns({"institution_ids": F.array("institution_id"), "institution_countries": F.array("institution_country")})
    return Y.academic_states(works, order=["order_no", "line_no"])


@query(
    "f12_output_states",
    """
WITH g AS (SELECT person_id, CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM outputs GROUP BY 1),
b AS (SELECT person_id, year, count(*) FILTER (WHERE event_type LIKE 'creation%') AS release_groups, count(*) FILTER (WHERE event_type LIKE 'perf%') AS performance_events,
  count(*) FILTER (WHERE event_type LIKE 'creation%' AND subtype = 'album') AS albums, count(*) FILTER (WHERE event_type LIKE 'creation%' AND subtype = 'single') AS singles, count(*) FILTER (WHERE event_type LIKE 'creation%' AND subtype = 'ep') AS eps FROM outputs GROUP BY 1, 2),
j AS (SELECT person_id, year, coalesce(release_groups, 0) AS release_groups, coalesce(performance_events, 0) AS performance_events, coalesce(albums, 0) AS albums, coalesce(singles, 0) AS singles, coalesce(eps, 0) AS eps FROM g LEFT JOIN b USING (person_id, year))
SELECT *, CAST(sum(release_groups) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_3y_release_groups, CAST(sum(release_groups) OVER (w) AS BIGINT) AS cumulative_release_groups, CAST(sum(performance_events) OVER (w) AS BIGINT) AS cumulative_performance_events,
  CAST(year - min(CASE WHEN release_groups > 0 THEN year END) OVER (w) AS INTEGER) AS years_since_first_release,
  CAST(CASE WHEN release_groups > 0 THEN year - max(CASE WHEN release_groups > 0 THEN year END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS INTEGER) AS release_gap_before_year,
  CAST(release_groups > 0 OR performance_events > 0 AS INTEGER) AS active_music_year
FROM j WINDOW w AS (PARTITION BY person_id ORDER BY year)""",
    "outputs",
)
def output_states(t):
    return Y.output_states(t.outputs)


@query(
    "f13_surrogate_ids",
    f"""WITH {P.CUTOFFS_SQL} SELECT example_id, i AS interval_index, row_number() OVER (ORDER BY example_id, i) AS person_period_id FROM cutoffs, (VALUES (0), (1), (2), (3), (4)) v(i)""",
    "persons",
)
def surrogate_ids(t):
    grid = training.interval_grid(P._cutoffs(t), "cutoff").select("example_id", "interval_index")
    return scale.rank_by_id(grid, "example_id", "person_period_id", then=["interval_index"])


@query(
    "f14_circular_donor",
    """
WITH g AS (SELECT person_id, country, CAST(year(birth_date) // 10 * 10 AS INTEGER) AS decade, sha256('7|' || person_id) AS h FROM persons)
SELECT person_id, country, decade, CASE WHEN count(*) OVER (PARTITION BY country, decade) > 1 THEN coalesce(lead(person_id) OVER w, first_value(person_id) OVER w) END AS donor_person_id
FROM g WINDOW w AS (PARTITION BY country, decade ORDER BY h)""",
    "persons",
)
def circular_donor(t):
    from chronica.functions import temporal as D

    people = t.persons.select(
        "person_id", "country", D.year_floor(F.year("birth_date"), 10).alias("decade"), scale.hash_order(F.lit("7"), F.col("person_id")).alias("h")
    )
    return scale.next_by_hash(people, ["country", "decade"], "h", "person_id", "donor_person_id").drop("h")
