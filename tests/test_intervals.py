"""The year tree and the matches that meet in it, against brute force."""

import random
from datetime import date

from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.operators import coverage as C


def test_a_year_meets_a_span_in_one_node(spark):
    draw = random.Random(5)
    spans = [(a, a + draw.choice([0, 1, 2, 7, 30, 100, 900])) for a in (draw.randint(-50, 2100) for _ in range(300))]
    spans += [(1, 9999), (4096, 8191), (0, 0), (1999, None), (None, 2000)]
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "i int, a int, b int")
    years = spark.range(-60, 3100, 13).select(F.col("id").cast("int").alias("y"))
    cover = rows.select("i", "a", "b", F.explode(C.year_cover(F.col("a"), F.col("b"))).alias("node"))
    for i, a, b, n in cover.groupBy("i", "a", "b").count().collect():
        assert n <= min(b - a + 1, 30 * C.YEAR_LEVELS) and (b - a < 99 or n < (b - a) / 2)
    path = years.select("y", F.explode(C.year_path(F.col("y"))).alias("node"))
    got = sorted((r.i, r.y) for r in cover.join(path, "node").collect())
    want = sorted((i, y) for i, (a, b) in enumerate(spans) if None not in (a, b) for y in range(-60, 3100, 13) if a <= y <= b)
    assert got == want


def test_matches_of_long_spans_ties_nulls_and_repeats(spark):
    draw = random.Random(8)
    sources = ["wikidata", "openalex", "orcid", "olympedia"]
    rows = []
    for i in range(260):
        start = date(draw.randint(1700, 2000), draw.randint(1, 12), draw.randint(1, 28))
        end = start.replace(year=start.year + draw.choice([0, 0, 0, 1, 3, 120]))
        subject = draw.choice([None, "", " ", "A", " a", "b"])
        rows.append((f"e{i:04d}", i % 5, "work", draw.choice(sources), subject, str(start), str(end)))
    rows += [(f"r{i}", 0, "work", s, "a", "1900-01-01", "1900-12-31") for i, s in enumerate(["wikidata", "openalex"] * 3)]
    rows += [("n0", 0, "work", "wikidata", "a", None, None), ("n1", 0, "work", "openalex", None, None, "1990-01-01")]
    cols = "event_id string, person_id int, event_family string, source_id string, subject_id string, date_min string, date_max string"
    events = spark.createDataFrame(rows, cols)
    family = dict(spark.createDataFrame([(s,) for s in sources], "s string").select("s", S.source_family(F.col("s"))).collect())
    want: dict = {}
    for a in rows:
        for b in rows:
            if a[1] != b[1] or family[a[3]] >= family[b[3]] or None in (a[5], b[5]):
                continue
            overlap = max(a[5], b[5]) <= min(a[6], b[6])
            if overlap or abs(int(a[5][:4]) - int(b[5][:4])) <= 1:
                key = (a[1], family[a[3]], family[b[3]], a[5], a[6], b[5], b[6], overlap)
                same = (a[4] or "").strip().lower() == (b[4] or "").strip().lower() != ""
                pairs, strong = want.get(key, (0, 0))
                want[key] = (pairs + 1, strong + (overlap and same))
    got = {
        (r.person_id, r.left_source, r.right_source, r.left_date_min, r.left_date_max, r.right_date_min, r.right_date_max, r.date_overlap): (r.pairs, r.strong_pairs)
        for r in C.cross_source_matches(events).collect()
    }
    assert got == want and any(s for _, s in want.values())
    assert C.cross_source_matches(events.limit(0)).count() == 0
