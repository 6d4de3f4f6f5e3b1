"""Queries: models fitted on repeated person splits, with the decade shuffle as control."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica import session
from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.operators import evaluation as V
from chronica.operators import repeated
from chronica.operators import training as M
from chronica.plans.evaluation import _matrix, rounded
from chronica.plans.registry import query

FOUR = vocab.CLASSES_4
HISTORY = ["birth_year", "gender_number", "cutoff_age", "history__events", "history__domains"]
MODELS = {
    "reality": HISTORY,
    "raw_birth": ["birth_year", "calendar__month", "birth_day", "cutoff_age"],
    "objective": ["chart__branch", "cutoff_age"],
    "reality_plus_objective": [*HISTORY, "chart__branch"],
    "reality_plus_shuffled": [*HISTORY, "shuffled__branch"],
}


def split_predictions(t):
    """Test rows of all seeds and models, kept for the queries below. All seeds of a model are fitted in one go."""

    def make():
        rows = _matrix(t).withColumns(
            {
                "birth_year": F.year("birth_date"),
                "birth_day": F.dayofmonth("birth_date"),
                "gender_number": F.when(F.col("background__gender") == "M", 1.0).when(F.col("background__gender") == "F", 0.0).otherwise(0.5),
                "decade": D.year_floor(F.year("birth_date"), 10),
            }
        )
        people = rows.select("person_id", "decade", "chart__branch").distinct()
        mixed = M.shuffled_within(people, ["decade"], ["chart__branch"], "decade-control")
        rows = rows.join(mixed.select("person_id", F.col("chart__branch").alias("shuffled__branch")), "person_id", "left")
        used = sorted({c for columns in MODELS.values() for c in columns})
        ready = repeated.prepared(rows, used, "y_class_4", FOUR, repeated.in_training(F.col("person_id")))
        ready = session.materialised(ready.select("example_id", "person_id", F.col("y_class_4").alias("y_true"), "__y", "__train", *[f"__{c}" for c in used]), "repeats")
        out = None
        for name, columns in MODELS.items():
            part = repeated.predict(repeated.fit(ready, columns, FOUR), ready, ["example_id", "person_id", "y_true"]).withColumn("model", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out

    return t.stage("split_predictions", make)


@query("n21_fitted_splits")
def fitted_splits(t):
    """Mean and spread over twenty person splits, and how often each model beats the history alone."""
    scored = V.with_losses(split_predictions(t), FOUR)
    by = ["seed", "model"]
    each = V.classification(scored, by, FOUR).join(scored.groupBy(*by).agg(F.avg("log_loss").alias("log_loss")), by)
    base = each.where("model = 'reality'").select("seed", F.col("macro_f1").alias("base"))
    out = each.join(base, "seed").groupBy("model").agg(
        F.count(F.lit(1)).alias("splits"),
        F.avg("macro_f1").alias("macro_f1_mean"),
        F.stddev_samp("macro_f1").alias("macro_f1_std"),
        F.avg("accuracy").alias("accuracy_mean"),
        F.avg("balanced_accuracy").alias("balanced_accuracy_mean"),
        F.avg("log_loss").alias("log_loss_mean"),
        F.avg(F.col("macro_f1") - F.col("base")).alias("delta_macro_f1_mean"),
        F.count_if(F.col("macro_f1") > F.col("base")).alias("positive_splits"),
    )
    return rounded(out, 6)


@query(
    "n21_split_integrity",
    f"""WITH s AS (SELECT unnest([{', '.join(map(str, repeated.SEEDS))}]) AS seed)
SELECT seed, model, count(*) AS n, count(DISTINCT person_id) AS people, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS not_normalised, CAST(0 AS BIGINT) AS outside
FROM examples, s, (VALUES {', '.join(f"('{m}')" for m in MODELS)}) m(model)
WHERE classification_eligible AND CAST('0x' || substr(sha256('split' || seed || '|' || person_id), 1, 8) AS BIGINT) % 100 < {repeated.TEST_PERCENT} GROUP BY 1, 2""",
    "examples",
)
def split_integrity(t):
    """Every seed scores exactly the people it was not fitted on, once, with probabilities that add up."""
    total = sum((V.p(c) for c in FOUR), F.lit(0.0))
    bad = F.greatest(*[F.when(V.p(c).between(0, 1), 0).otherwise(1) for c in FOUR]) == 1
    rows, on = split_predictions(t), ["seed", "model"]
    sums = rows.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(total - 1) > 1e-9).alias("not_normalised"),
        F.count_if(bad).alias("outside"),
    )
    out = sums.join(_distinct(rows, "person_id", "people"), on, "left").join(_distinct(rows, "example_id", "__examples"), on, "left")
    out = out.na.fill(0, ["people", "__examples"])
    return out.select(*on, "n", "people", (F.col("n") - F.col("__examples")).alias("duplicates"), "not_normalised", "outside")


def _distinct(rows, key, name):
    """Different keys per seed and model. All seeds of a key meet in one row before the shuffle, not a row each."""
    seen = rows.where(F.col(key).isNotNull()).groupBy("model", key).agg(*[F.max(F.col("seed") == s).alias(f"s{s}") for s in repeated.SEEDS])
    counts = seen.groupBy("model").agg(*[F.count_if(f"s{s}").alias(f"s{s}") for s in repeated.SEEDS])
    each = F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"s{s}").alias(name)) for s in repeated.SEEDS])
    return counts.select("model", F.inline(each)).where(F.col(name) > 0)
