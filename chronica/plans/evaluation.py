"""Queries: priors, metrics, horizons, bootstraps and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica import session
from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.operators import evaluation as V
from chronica.operators import models
from chronica.operators import snapshots as N
from chronica.operators import training as M
from chronica.plans.registry import query
from chronica.plans.training import HISTORY_SQL

CLASSES = vocab.HAZARD_CLASSES
FOUR = vocab.CLASSES_4


def rounded(df, digits=9):
    """Averages differ in their last bits between engines."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def shares_sql(classes, label, where="TRUE"):
    return ", ".join(f"count(*) FILTER (WHERE {label} = '{c}') / count(*) AS p_{c}" for c in classes)


# --- priors -----------------------------------------------------------------
@query(
    "n01_train_prior",
    f"""WITH pr AS (SELECT {shares_sql(FOUR, 'y_class_4')} FROM examples WHERE split_name = 'train' AND classification_eligible)
SELECT example_id, split_name, round(p_career, 9) AS p_career, round(p_recognition, 9) AS p_recognition, round(p_relationship, 9) AS p_relationship, round(p_other, 9) AS p_other FROM examples, pr WHERE classification_eligible""",
    "examples",
)
def train_prior(t):
    rows = t.examples.where("classification_eligible").select("example_id", "split_name", "y_class_4")
    return rounded(V.train_prior(rows, FOUR, "y_class_4").drop("y_class_4"))


@query(
    "n02_interval_prior",
    f"""WITH pr AS (SELECT interval_index, {shares_sql(CLASSES, 'outcome_class')} FROM periods WHERE split_name = 'train' GROUP BY 1),
ov AS (SELECT {shares_sql(CLASSES, 'outcome_class').replace(' AS p_', ' AS q_')} FROM periods WHERE split_name = 'train')
SELECT p.person_period_id, {', '.join(f'round(coalesce(p_{c}, q_{c}), 9) AS p_{c}' for c in CLASSES)} FROM periods p LEFT JOIN pr ON pr.interval_index = p.interval_index, ov""",
    "periods",
)
def interval_prior(t):
    rows = t.periods.select("person_period_id", "interval_index", "outcome_class", "split_name")
    out = V.interval_prior(rows, CLASSES, "outcome_class")
    return rounded(out.select("person_period_id", *[f"p_{c}" for c in CLASSES]))


VARIANTS = {
    "history": ("history__", "background__"),
    "raw_calendar": ("calendar__",),
    "objective": ("chart__",),
    "history_plus_objective": ("history__", "background__", "chart__"),
    "placebo": ("placebo__",),
}
WIDE_SQL = f"""wide AS (SELECT e.example_id, coalesce(a.n, 0) AS history__events, coalesce(a.domains, 0) AS history__domains, e.gender AS background__gender, CAST(month(e.birth_date) AS INTEGER) AS calendar__month,
  CASE WHEN e.person_id % 6 > 0 THEN e.person_id % 12 END AS chart__branch, CASE WHEN e.person_id % 4 > 0 THEN (e.person_id + 7) % 12 END AS placebo__branch FROM examples e LEFT JOIN arms a ON a.example_id = e.example_id AND a.snapshot = 'new')"""


def _wide(t, *carried):
    arms = M.histories(t.examples, t.facts, "cutoff").where(F.col("snapshot") == "new")
    rows = t.examples.join(
        arms.select("example_id", F.col("canonical_event_count").alias("history__events"), F.col("domain_count").alias("history__domains")), "example_id", "left"
    ).na.fill(0, ["history__events", "history__domains"])
    key = F.col("person_id")
    return rows.select(
        "example_id", "person_id", "split_name", "y_class_4", "classification_eligible", "cutoff_age", "birth_date", "history__events", "history__domains",
        F.col("gender").alias("background__gender"),
        F.month("birth_date").alias("calendar__month"),
        F.when(key % 6 > 0, key % 12).alias("chart__branch"),
        F.when(key % 4 > 0, (key + 7) % 12).alias("placebo__branch"),
        *carried,
    )


def _variant_sql():
    cols = ["history__events", "history__domains", "background__gender", "calendar__month", "chart__branch", "placebo__branch"]
    arms = []
    for name, prefixes in VARIANTS.items():
        used = [c for c in cols if c.startswith(prefixes)]
        arms.append(f"SELECT '{name}' AS variant, CAST({len(used)} AS INTEGER) AS columns, " + " + ".join(f"count({c})" for c in used) + " AS filled FROM wide")
    return f"WITH {HISTORY_SQL}, {WIDE_SQL} " + " UNION ALL ".join(arms)


@query("n03_feature_variants", _variant_sql(), "examples facts")
def feature_variants(t):
    wide = _wide(t)
    sets = models.variant_columns(wide.columns, VARIANTS)
    used = sorted({c for cols in sets.values() for c in cols})
    counts = wide.agg(*[F.count(c).alias(c) for c in used])
    entries = [
        F.struct(F.lit(n).alias("variant"), F.lit(len(cols)).alias("columns"), sum((F.col(c) for c in cols), F.lit(0)).cast("bigint").alias("filled"))
        for n, cols in sets.items()
    ]
    return counts.select(F.inline(F.array(*entries)))


@query(
    "n08_balanced_weights",
    """WITH c AS (SELECT outcome_class, count(*) AS n FROM periods WHERE split_name = 'train' GROUP BY 1)
SELECT p.person_period_id, p.outcome_class, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n), 9) AS weight FROM periods p JOIN c ON c.outcome_class = p.outcome_class WHERE p.split_name = 'train'""",
    "periods",
)
def balanced_weights(t):
    train = t.periods.where(F.col("split_name") == "train").select("person_period_id", "outcome_class")
    return rounded(V.balanced_weights(train, "outcome_class").select("person_period_id", "outcome_class", "weight"))


# --- metrics ----------------------------------------------------------------
def _argmax_sql(classes):
    best = f"greatest({', '.join(f'p_{c}' for c in classes)})"
    return "CASE " + " ".join(f"WHEN p_{c} = {best} THEN '{c}'" for c in classes) + " END"


def scored_sql(classes, source="predictions"):
    brier = " + ".join(f"pow(p_{c} - CASE WHEN y_true = '{c}' THEN 1.0::DOUBLE ELSE 0 END, 2)" for c in classes)
    loss = "CASE y_true " + " ".join(f"WHEN '{c}' THEN p_{c}" for c in classes) + " END"
    return f"""SELECT *, {_argmax_sql(classes)} AS y_pred, -ln(greatest({loss}, 1e-15::DOUBLE)) AS log_loss, {brier} AS brier, greatest({', '.join(f'p_{c}' for c in classes)}) AS confidence FROM {source}"""


def per_class_sql(by, classes, source="scored"):
    listed = ", ".join(f"('{c}')" for c in classes)
    on = " AND ".join(f"s.{b} = g.{b}" for b in by)
    keys = ", ".join(f"g.{b}" for b in by)
    return f"""SELECT {', '.join(by)}, class, tp, support, predicted, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted)::DOUBLE ELSE 0.0 END AS f1
FROM (SELECT {keys}, class, count(*) FILTER (WHERE y_true = class AND y_pred = class) AS tp, count(*) FILTER (WHERE y_true = class) AS support, count(*) FILTER (WHERE y_pred = class) AS predicted
  FROM (SELECT DISTINCT {', '.join(by)} FROM {source}) g JOIN (VALUES {listed}) c(class) ON TRUE JOIN {source} s ON {on} GROUP BY {keys}, class)"""


BY = ["variant", "split_name"]


@query(
    "n09_class_scores",
    f"WITH scored AS ({scored_sql(CLASSES)}), pc AS ({per_class_sql(BY, CLASSES)}) SELECT variant, split_name, class, tp, support, predicted, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM pc",
    "predictions",
)
def class_scores(t):
    scored = t.predictions.withColumn("y_pred", V.top_label(CLASSES))
    return rounded(V.per_class(scored, BY, CLASSES))


@query(
    "n09_macro_f1",
    f"""WITH scored AS ({scored_sql(CLASSES)}), pc AS ({per_class_sql(BY, CLASSES)}) SELECT variant, split_name, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 9) AS accuracy,
  round(avg(recall) FILTER (WHERE support > 0), 9) AS balanced_accuracy, round(avg(f1), 9) AS macro_f1 FROM pc GROUP BY 1, 2""",
    "predictions",
)
def macro_f1(t):
    return rounded(V.classification(t.predictions.withColumn("y_pred", V.top_label(CLASSES)), BY, CLASSES))


@query("n10_log_loss", f"WITH scored AS ({scored_sql(CLASSES)}) SELECT variant, split_name, round(avg(log_loss), 9) AS log_loss FROM scored GROUP BY 1, 2", "predictions")
def log_loss(t):
    return rounded(V.with_losses(t.predictions, CLASSES).groupBy(*BY).agg(F.avg("log_loss").alias("log_loss")))


@query("n11_brier", f"WITH scored AS ({scored_sql(CLASSES)}) SELECT variant, split_name, round(avg(brier), 9) AS brier FROM scored GROUP BY 1, 2", "predictions")
def brier(t):
    return rounded(V.with_losses(t.predictions, CLASSES).groupBy(*BY).agg(F.avg("brier").alias("brier")))


ECE_SQL = """SELECT {by}, sum(n * abs(acc - conf)) / sum(n) AS ece_10bin FROM (SELECT {by}, least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(CASE WHEN y_pred = y_true THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(confidence) AS conf FROM scored GROUP BY {by}, bin) GROUP BY {by}"""


@query("n12_calibration_error", f"WITH scored AS ({scored_sql(CLASSES)}), e AS ({ECE_SQL.format(by='variant, split_name')}) SELECT variant, split_name, round(ece_10bin, 9) AS ece_10bin FROM e", "predictions")
def calibration_error(t):
    return rounded(V.calibration(V.with_losses(t.predictions, CLASSES), BY))


def conditional_sql(source="predictions"):
    classes = vocab.EVENT_CLASSES
    total = " + ".join(f"p_{c}" for c in classes)
    others = [c for c in CLASSES if c not in classes]
    cols = ", ".join(f"p_{c} / ({total}) AS p_{c}" for c in classes)
    return f"(SELECT * REPLACE ({cols}) FROM {source} WHERE y_true <> 'no_event')"


@query(
    "n13_conditional_metrics",
    f"""WITH scored AS ({scored_sql(vocab.EVENT_CLASSES, conditional_sql())}), pc AS ({per_class_sql(BY, vocab.EVENT_CLASSES)}),
f AS (SELECT variant, split_name, avg(f1) AS f1 FROM pc GROUP BY 1, 2), l AS (SELECT variant, split_name, count(*) AS n, avg(log_loss) AS ll FROM scored GROUP BY 1, 2),
e AS (SELECT variant, split_name, avg(pow(1 - p_no_event - CASE WHEN y_true <> 'no_event' THEN 1.0::DOUBLE ELSE 0 END, 2)) AS eb FROM predictions GROUP BY 1, 2)
SELECT l.variant, l.split_name, l.n AS n_event, round(ll, 9) AS conditional_log_loss, round(f1, 9) AS conditional_macro_f1, round(eb, 9) AS event_brier FROM l JOIN f USING (variant, split_name) JOIN e USING (variant, split_name)""",
    "predictions",
)
def conditional_metrics(t):
    happened = (F.col("y_true") != "no_event").cast("double")
    events = t.predictions.groupBy(*BY).agg(F.avg((1.0 - V.p("no_event") - happened) ** 2).alias("event_brier"))
    return rounded(V.conditional_metrics(t.predictions, BY).join(events, BY))


# --- horizons ---------------------------------------------------------------
CIF_SQL = f"""
s AS (SELECT *, coalesce(exp(sum(ln(greatest(p_no_event, 1e-300::DOUBLE))) OVER (PARTITION BY example_id, variant ORDER BY interval_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS sv FROM grid_predictions),
c AS (SELECT *, sv * p_no_event AS surv, {', '.join(f'sum(sv * p_{x}) OVER w AS c_{x}' for x in vocab.EVENT_CLASSES)} FROM s WINDOW w AS (PARTITION BY example_id, variant ORDER BY interval_index)),
hz AS (SELECT example_id, person_id, split_name, variant, end_year AS horizon_years, surv AS survival_probability, surv / (surv + {' + '.join(f'c_{x}' for x in vocab.EVENT_CLASSES)}) AS p_no_event,
  {', '.join(f"c_{x} / (surv + {' + '.join(f'c_{y}' for y in vocab.EVENT_CLASSES)}) AS p_{x}" for x in vocab.EVENT_CLASSES)},
  target_observable_from IS NOT NULL OR obs_end >= d1 AS evaluable,
  CASE WHEN target_observable_from IS NOT NULL THEN CASE WHEN target_observable_from <= d1 THEN CASE WHEN target_domain IN ('career', 'recognition', 'relationship') THEN target_domain ELSE 'other' END ELSE 'no_event' END WHEN obs_end >= d1 THEN 'no_event' END AS y_true FROM c)
"""


def _horizons(t):
    return V.horizon_truth(V.cumulative_incidence(t.grid_predictions, ["example_id", "variant"]))


@query(
    "n14_cumulative_incidence",
    f"WITH {CIF_SQL} SELECT example_id, variant, horizon_years, round(survival_probability, 9) AS survival_probability, {', '.join(f'round(p_{c}, 9) AS p_{c}' for c in CLASSES)} FROM hz",
    "grid_predictions",
)
def cumulative_incidence(t):
    return rounded(_horizons(t).select("example_id", "variant", "horizon_years", "survival_probability", *[f"p_{c}" for c in CLASSES]))


@query(
    "n15_horizon_truth",
    f"WITH {CIF_SQL} SELECT horizon_years, evaluable, y_true, count(*) AS n FROM hz WHERE variant = 'a' GROUP BY 1, 2, 3",
    "grid_predictions",
)
def horizon_truth(t):
    rows = _horizons(t).where(F.col("variant") == "a")
    return rows.groupBy("horizon_years", "evaluable", "y_true").agg(F.count(F.lit(1)).alias("n"))


HBY = ["variant", "split_name", "horizon_years"]
HKEYS = ", ".join(HBY)


@query(
    "n16_horizon_metrics",
    f"""WITH {CIF_SQL}, ev AS (SELECT * FROM hz WHERE evaluable), scored AS ({scored_sql(CLASSES, 'ev')}), pc AS ({per_class_sql(HBY, CLASSES)}), e AS ({ECE_SQL.format(by=HKEYS)}),
m AS (SELECT {HKEYS}, CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy, avg(recall) FILTER (WHERE support > 0) AS ba, avg(f1) AS f1 FROM pc GROUP BY {HKEYS}),
l AS (SELECT {HKEYS}, avg(log_loss) AS ll, avg(brier) AS br, avg(pow(1 - p_no_event - CASE WHEN y_true <> 'no_event' THEN 1.0::DOUBLE ELSE 0 END, 2)) AS eb FROM scored GROUP BY {HKEYS})
SELECT {HKEYS}, n, round(accuracy, 8) AS accuracy, round(ba, 8) AS balanced_accuracy, round(f1, 8) AS macro_f1, round(ll, 8) AS log_loss, round(br, 8) AS brier_multiclass, round(eb, 8) AS event_brier, round(ece_10bin, 8) AS ece_10bin
FROM m JOIN l USING ({HKEYS}) JOIN e USING ({HKEYS})""",
    "grid_predictions",
)
def horizon_metrics(t):
    rows = _horizons(t).where("evaluable")
    out = V.interval_metrics(rows, HBY)
    return rounded(out.drop("n_event", "conditional_log_loss", "conditional_macro_f1"), 8)


# --- bootstraps -------------------------------------------------------------
def weights_sql(reps, seed="boot"):
    bounds = " + ".join(f"(u >= {b})::INT" for b in V.POISSON_BOUNDS)
    return f"""draws AS (SELECT person_id, blk * 16 + wd AS rep, {bounds} AS w FROM (
  SELECT person_id, blk, wd, CAST('0x' || substr(h, 1 + 4 * wd, 4) AS INTEGER) AS u FROM (
    SELECT person_id, blk, sha256('{seed}|' || person_id || '|' || blk) AS h FROM (SELECT DISTINCT person_id FROM predictions) d, range(0, {-(-reps // 16)}) r(blk)), range(0, 16) q(wd)) WHERE blk * 16 + wd < {reps})"""


def bootstrap_sql(reps, by=""):
    keys = f"{by}, " if by else ""
    join = f" AND x.{by} = y.{by}" if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""WITH {HISTORY_SQL}, strata AS (SELECT e.example_id, CASE WHEN coalesce(a.n, 0) = 0 THEN '0' WHEN a.n = 1 THEN '1' WHEN a.n <= 4 THEN '2-4' ELSE '5+' END AS stratum FROM examples e LEFT JOIN arms a ON a.example_id = e.example_id AND a.snapshot = 'new'),
scored AS (SELECT q.*, stratum FROM ({scored_sql(CLASSES)}) q JOIN strata USING (example_id) WHERE split_name = 'test'), {weights_sql(reps)},
pp AS (SELECT {keys.replace('stratum', 'a.stratum')}a.person_id, sum(a.log_loss - b.log_loss) AS loss, sum(a.brier - b.brier) AS brier, count(*) AS n FROM scored a JOIN scored b ON a.person_period_id = b.person_period_id AND a.variant = 'a' AND b.variant = 'b' GROUP BY ALL),
reps AS (SELECT {keys}rep, sum(w * loss) / sum(w * n) AS dl, sum(w * brier) / sum(w * n) AS db FROM pp JOIN draws USING (person_id) GROUP BY ALL HAVING sum(w * n) > 0),
y AS (SELECT {keys}count(*) AS reps, quantile_cont(dl, 0.025) AS loss_low, quantile_cont(dl, 0.975) AS loss_high, avg((dl < 0)::INT::DOUBLE) AS lf, quantile_cont(db, 0.025) AS brier_low, quantile_cont(db, 0.975) AS brier_high, avg((db < 0)::INT::DOUBLE) AS bf FROM reps{group}),
x AS (SELECT {keys}CAST(sum(n) AS BIGINT) AS paired_rows, count(*) AS paired_people, sum(loss) / sum(n) AS dl, sum(brier) / sum(n) AS db FROM pp{group})
SELECT {keys.replace('stratum', 'x.stratum')}paired_rows, paired_people, round(x.dl, 8) AS delta_log_loss, round(x.db, 8) AS delta_brier, reps, round(loss_low, 8) AS loss_low, round(loss_high, 8) AS loss_high, round(lf, 8) AS loss_negative_fraction,
  round(brier_low, 8) AS brier_low, round(brier_high, 8) AS brier_high, round(bf, 8) AS brier_negative_fraction FROM x JOIN y ON TRUE{join}"""


def _arms(t):
    test = t.predictions.where(F.col("split_name") == "test")
    return test.where(F.col("variant") == "a"), test.where(F.col("variant") == "b")


@query("n17_paired_bootstrap", bootstrap_sql(1000), "predictions facts")
def paired_bootstrap(t):
    a, b = _arms(t)
    return rounded(V.paired_bootstrap(a, b, ["person_period_id"], CLASSES, reps=1000), 8)


@query(
    "n18_f1_bootstrap",
    f"""WITH scored AS (SELECT * FROM ({scored_sql(CLASSES)}) WHERE split_name = 'test'), {weights_sql(1000)},
j AS (SELECT a.person_id, a.y_true, a.y_pred AS pa, b.y_pred AS pb FROM scored a JOIN scored b ON a.person_period_id = b.person_period_id AND a.variant = 'a' AND b.variant = 'b'),
k AS (SELECT rep, class, sum(w * (y_true = class)::INT) AS s, sum(w * (y_true = class AND pa = class)::INT) AS ta, sum(w * (pa = class)::INT) AS na, sum(w * (y_true = class AND pb = class)::INT) AS tb, sum(w * (pb = class)::INT) AS nb
  FROM j JOIN draws USING (person_id), (VALUES {', '.join(f"('{c}')" for c in CLASSES)}) c(class) GROUP BY 1, 2),
r AS (SELECT rep, avg(CASE WHEN s + na > 0 THEN 2 * ta / (s + na)::DOUBLE ELSE 0 END) - avg(CASE WHEN s + nb > 0 THEN 2 * tb / (s + nb)::DOUBLE ELSE 0 END) AS d FROM k GROUP BY 1)
SELECT count(*) AS reps, round(avg(d), 8) AS bootstrap_mean, round(quantile_cont(d, 0.025), 8) AS ci95_low, round(quantile_cont(d, 0.5), 8) AS bootstrap_median, round(quantile_cont(d, 0.975), 8) AS ci95_high, round(avg((d > 0)::INT::DOUBLE), 8) AS positive_fraction FROM r""",
    "predictions",
)
def f1_bootstrap(t):
    a, b = _arms(t)
    return rounded(V.f1_bootstrap(a, b, ["person_period_id"], CLASSES, reps=1000), 8)


@query("n19_sparse_history_bootstrap", bootstrap_sql(1000, "stratum"), "predictions facts")
def sparse_history_bootstrap(t):
    arms = M.histories(t.examples, t.facts, "cutoff").where(F.col("snapshot") == "new").select("example_id", F.col("canonical_event_count").alias("n"))
    n = F.coalesce("n", F.lit(0))
    stratum = F.when(n == 0, "0").when(n == 1, "1").when(n <= 4, "2-4").otherwise("5+")
    strata = t.examples.select("example_id").join(arms, "example_id", "left").select("example_id", stratum.alias("stratum"))
    a, b = _arms(t)
    return rounded(V.paired_bootstrap(a.join(strata, "example_id"), b, ["person_period_id"], CLASSES, reps=1000, by=["stratum"]), 8)


@query(
    "n20_raw_domain_f1",
    """WITH p AS (SELECT example_id, split_name, target_domain AS y, CASE WHEN example_id % 3 = 0 THEN target_domain WHEN example_id % 3 = 1 THEN 'career' ELSE 'unlisted' END AS z FROM examples WHERE classification_eligible),
cl AS (SELECT split_name, y AS class FROM p UNION SELECT split_name, z FROM p),
f AS (SELECT c.split_name, c.class, count(*) FILTER (WHERE y = class AND z = class) AS tp, count(*) FILTER (WHERE y = class) AS s, count(*) FILTER (WHERE z = class) AS n FROM cl c JOIN p ON p.split_name = c.split_name GROUP BY 1, 2)
SELECT split_name, CAST(sum(s) AS BIGINT) AS n, round(sum(tp) / sum(s), 9) AS accuracy, round(avg(tp / s) FILTER (WHERE s > 0), 9) AS balanced_accuracy, round(avg(2 * tp / (s + n)), 9) AS macro_f1 FROM f GROUP BY 1""",
    "examples",
)
def raw_domain_f1(t):
    third = F.col("example_id") % 3
    guess = F.when(third == 0, F.col("target_domain")).when(third == 1, "career").otherwise("unlisted")
    rows = t.examples.where("classification_eligible").select("split_name", F.col("target_domain").alias("y_true"), guess.alias("y_pred"))
    return rounded(V.classification(rows, ["split_name"]))


@query(
    "n21_repeated_splits",
    f"""WITH scored AS (SELECT q.*, seed FROM ({scored_sql(CLASSES)}) q, range(0, 5) r(seed) WHERE CAST('0x' || substr(sha256('seed' || seed || '|' || person_id), 1, 8) AS BIGINT) % 100 < 20), pc AS ({per_class_sql(['seed', 'variant'], CLASSES)}),
m AS (SELECT seed, avg(f1) FILTER (WHERE variant = 'a') AS a, avg(f1) FILTER (WHERE variant = 'b') AS b FROM pc GROUP BY 1)
SELECT count(*) AS splits, round(avg(a), 9) AS mean_a, round(stddev_samp(a), 9) AS std_a, round(avg(b), 9) AS mean_b, round(stddev_samp(b), 9) AS std_b, count(*) FILTER (WHERE a > b) AS wins_a FROM m""",
    "predictions",
)
def repeated_splits(t):
    seeds = range(5)
    inside = F.filter(
        F.array(*[F.when(M.hash_bucket(F.col("person_id"), f"seed{s}") < 20, F.lit(s)) for s in seeds]), lambda x: x.isNotNull()
    )
    rows = t.predictions.withColumn("y_pred", V.top_label(CLASSES)).withColumn("seed", F.explode(inside))
    scores = V.classification(rows, ["seed", "variant"], CLASSES)
    paired = scores.groupBy("seed").agg(*[F.max(F.when(F.col("variant") == v, F.col("macro_f1"))).alias(v) for v in "ab"])
    return rounded(
        paired.agg(
            F.count(F.lit(1)).alias("splits"),
            *[f(F.col(v)).alias(f"{n}_{v}") for v in "ab" for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
            F.count_if(F.col("a") > F.col("b")).alias("wins_a"),
        )
    )


@query(
    "n22_prediction_integrity",
    f"""WITH {CIF_SQL}, bad AS (SELECT * REPLACE (CASE WHEN person_period_id % 37 = 0 THEN p_career - 1 ELSE p_career END AS p_career) FROM predictions
  UNION ALL SELECT * FROM predictions WHERE person_period_id % 41 = 0),
bh AS (SELECT * REPLACE (CASE WHEN example_id % 43 = 0 THEN horizon_years ELSE survival_probability END AS survival_probability, CASE WHEN example_id % 47 > 0 THEN y_true END AS y_true) FROM hz)
SELECT audit, observed, observed = 0 AS passed FROM (
SELECT 'probabilities_do_not_sum_to_one' AS audit, (SELECT count(*) FROM bad WHERE abs({' + '.join(f'p_{c}' for c in CLASSES)} - 1) > 1e-9) AS observed
UNION ALL SELECT 'negative_probability', (SELECT count(*) FROM bad WHERE least({', '.join(f'p_{c}' for c in CLASSES)}) < 0)
UNION ALL SELECT 'duplicate_keys', (SELECT count(*) FROM (SELECT person_period_id, variant FROM bad GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'survival_rises', (SELECT count(*) FROM (SELECT survival_probability AS s, lag(survival_probability) OVER (PARTITION BY example_id, variant ORDER BY horizon_years) AS b FROM bh) WHERE s > b + 1e-12)
UNION ALL SELECT 'truth_without_evaluability', (SELECT count(*) FROM bh WHERE evaluable <> (y_true IS NOT NULL)))""",
    "predictions grid_predictions",
)
def prediction_integrity(t):
    """Every check meets rows that violate it."""
    key, example = F.col("person_period_id"), F.col("example_id")
    wrong = F.when(key % 37 == 0, F.col("p_career") - 1).otherwise(F.col("p_career"))
    bad = t.predictions.withColumn("p_career", wrong).unionByName(t.predictions.where(key % 41 == 0))
    horizons = _horizons(t).withColumns(
        {
            "survival_probability": F.when(example % 43 == 0, F.col("horizon_years").cast("double")).otherwise(F.col("survival_probability")),
            "y_true": F.when(example % 47 > 0, F.col("y_true")),
        }
    )
    checks = {**V.integrity(bad, ["person_period_id", "variant"], CLASSES), **V.horizon_integrity(horizons, ["example_id", "variant"])}
    return N.audit_rows(list(checks.items()))


@query(
    "n23_probability_alignment",
    f"""SELECT person_period_id, {', '.join(f"round(CASE WHEN tot > 0 THEN q_{c} / tot ELSE 0.2::DOUBLE END, 9) AS p_{c}" for c in CLASSES)}
FROM (SELECT *, {' + '.join(f'q_{c}' for c in CLASSES)} AS tot FROM (SELECT person_period_id, CASE WHEN person_period_id % 7 = 0 THEN 0 ELSE p_career END AS q_career, 0.0::DOUBLE AS q_no_event, CASE WHEN person_period_id % 7 = 0 THEN 0 ELSE p_other END AS q_other,
  0.0::DOUBLE AS q_recognition, CASE WHEN person_period_id % 7 = 0 OR person_period_id % 3 = 0 THEN 0 ELSE p_relationship END AS q_relationship FROM predictions WHERE variant = 'a'))""",
    "predictions",
)
def probability_alignment(t):
    key = F.col("person_period_id")
    zero = F.lit(0.0)
    known = F.create_map(
        F.lit("career"), F.when(key % 7 == 0, zero).otherwise(V.p("career")),
        F.lit("other"), F.when(key % 7 == 0, zero).otherwise(V.p("other")),
        F.lit("relationship"), F.when((key % 7 == 0) | (key % 3 == 0), zero).otherwise(V.p("relationship")),
        F.lit("unlisted"), F.lit(0.5),
    )
    rows = t.predictions.where(F.col("variant") == "a").select("person_period_id", known.alias("m"))
    return rounded(V.align(rows, "m", CLASSES).drop("m"))


@query(
    "n25_ledger_scoring",
    """
WITH l AS (SELECT example_id AS prediction_id, person_id, cutoff, CAST(cutoff + INTERVAL 5 YEAR AS DATE) AS horizon_end, obs_end, (example_id % 101) / 101.0::DOUBLE AS probability, example_id % 10 > 0 AS locked FROM examples),
r AS (SELECT l.*, (SELECT min(observable_from) FROM raw_events e WHERE e.person_id = l.person_id AND e.domain = 'career' AND e.observable_from > l.cutoff AND e.observable_from <= l.horizon_end) AS resolved_by FROM l WHERE locked)
SELECT prediction_id, resolved_by::VARCHAR AS resolved_by, CASE WHEN resolved_by IS NOT NULL THEN 1 WHEN horizon_end <= obs_end THEN 0 END AS outcome, round(pow(probability - CASE WHEN resolved_by IS NOT NULL THEN 1 WHEN horizon_end <= obs_end THEN 0 END, 2), 9) AS brier FROM r""",
    "examples raw_events",
)
def ledger_scoring(t):
    key = F.col("example_id")
    ledger = t.examples.select(
        key.alias("prediction_id"), "person_id", "cutoff", "obs_end",
        F.lit("career").alias("domain"), D.add_years(F.col("cutoff"), 5).alias("horizon_end"),
        ((key % 101) / 101).alias("probability"), (key % 10 > 0).alias("locked"),
    )
    out = V.ledger_outcomes(ledger, t.raw_events)
    return rounded(out.select("prediction_id", "resolved_by", "outcome", "brier"))


# --- fitted models (rows only) ----------------------------------------------
def _matrix(t):
    return _wide(t).where("classification_eligible")


NUMERIC = ["history__events", "history__domains", "chart__branch"]
CATEGORICAL = ["background__gender", "calendar__month"]


def _hot_sql(column, after=None):
    """Slots of a one-hot column: the training rows' categories, most frequent first, then the one for all others."""
    text = f"coalesce(CAST({column} AS VARCHAR), 'missing')"
    train = "FROM m WHERE split_name = 'train'"
    start = f"3 + (SELECT count(DISTINCT coalesce(CAST({after} AS VARCHAR), 'missing')) + 2 {train})" if after else "3"
    return f"""SELECT example_id, CAST({start} + coalesce(i, (SELECT count(DISTINCT {text}) {train})) AS INTEGER) AS slot, 1.0::DOUBLE AS value
FROM m LEFT JOIN (SELECT c, row_number() OVER (ORDER BY n DESC, c) - 1 AS i FROM (SELECT {text} AS c, count(*) AS n {train} GROUP BY 1)) k ON k.c = {text}"""


@query(
    "n04_preprocessing",
    f"""WITH {HISTORY_SQL}, {WIDE_SQL}, m AS (SELECT w.*, e.split_name FROM wide w JOIN examples e ON e.example_id = w.example_id WHERE classification_eligible),
num AS (SELECT example_id, split_name, unnest([{{'s': 0, 'x': CAST(history__events AS DOUBLE)}}, {{'s': 1, 'x': CAST(history__domains AS DOUBLE)}}, {{'s': 2, 'x': CAST(chart__branch AS DOUBLE)}}]) AS e FROM m),
med AS (SELECT e.s AS s, median(e.x) AS md FROM num WHERE split_name = 'train' GROUP BY 1),
filled AS (SELECT example_id, split_name, med.s AS s, coalesce(e.x, md) AS x FROM num JOIN med ON med.s = e.s),
mom AS (SELECT s, avg(x) AS mu, stddev_samp(x) AS sd FROM filled WHERE split_name = 'train' GROUP BY 1),
slots AS (SELECT example_id, CAST(f.s AS INTEGER) AS slot, (x - mu) / sd AS value FROM filled f JOIN mom ON mom.s = f.s
  UNION ALL {_hot_sql('background__gender')} UNION ALL {_hot_sql('calendar__month', 'background__gender')})
SELECT example_id, slot, round(value, 6) + 0.0 AS value FROM slots WHERE value <> 0""",
    "examples facts",
)
def preprocessing(t):
    """Imputed, scaled and one-hot encoded features, fitted on train only: the slots that are not zero."""
    from pyspark.ml.functions import vector_to_array

    rows = models.prepared(_matrix(t), NUMERIC, CATEGORICAL).select("example_id", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return rows.where("value <> 0").select("example_id", "slot", (F.round("value", 6) + 0.0).alias("value"))


def _balanced(t):
    out = models.logistic(_matrix(t), NUMERIC, CATEGORICAL, "y_class_4", FOUR, balanced=True)
    return V.with_losses(out.withColumnRenamed("y_class_4", "y_true"), FOUR)


def _by_class(scored, weight=None):
    """Rows per split and class, with the (weighted) mean probability of each class over all rows of the split."""
    weight = F.lit(1.0) if weight is None else weight
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class_name"), V.p(c).alias("p")) for c in FOUR])).alias("e")
    total = sum((V.p(c) for c in FOUR), F.lit(0.0))
    rows = scored.select("example_id", "split_name", "y_true", weight.alias("w"), (F.abs(total - 1) > 1e-9).alias("off"), each)
    return rows.groupBy("split_name", "e.class_name").agg(
        F.count_if(F.col("y_true") == F.col("e.class_name")).alias("n"),
        (F.count(F.lit(1)) - F.count_distinct("example_id")).alias("duplicates"),
        F.count_if("off").alias("not_normalised"),
        (F.sum(F.col("w") * F.col("e.p")) / F.sum("w")).alias("mean_p"),
    )


def _share_sql(split, share):
    names = ", ".join(f"('{c}')" for c in FOUR)
    return f"""WITH m AS (SELECT {split} AS split_name, y_class_4 FROM examples WHERE classification_eligible),
g AS (SELECT DISTINCT split_name, class_name FROM m, (VALUES {names}) v(class_name))
SELECT g.split_name, class_name, count(*) FILTER (WHERE y_class_4 = class_name) AS n, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS not_normalised,
  CASE WHEN g.split_name = 'train' THEN round({share}, 3) END AS mean_p FROM g JOIN m USING (split_name) GROUP BY 1, 2"""


@query("n05_logistic_integrity", _share_sql("split_name", "0.25::DOUBLE"), "examples")
def logistic_integrity(t):
    """A normalised prediction per example; where the fit is at its optimum, the balanced weights of the training
    rows give every class the same mean probability."""
    scored = _balanced(t)
    sizes = scored.where("split_name = 'train'").groupBy("y_true").agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    out = _by_class(scored.join(sizes, "y_true", "left"), F.coalesce("weight", F.lit(0.0)))
    return out.withColumn("mean_p", F.when(F.col("split_name") == "train", F.round("mean_p", 3)))


@query("n05_multinomial_logistic")
def multinomial_logistic(t):
    scored = _balanced(t)
    return rounded(scored.groupBy("split_name").agg(F.count(F.lit(1)).alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier")), 6)


@query("n06_boosted_one_vs_rest")
def boosted_one_vs_rest(t):
    out = models.boosted(_matrix(t), NUMERIC, CATEGORICAL, "y_class_4", FOUR, **models.CAPACITIES["small"])
    scored = V.with_losses(out.withColumnRenamed("y_class_4", "y_true"), FOUR)
    return rounded(scored.groupBy("split_name").agg(F.count(F.lit(1)).alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier")), 6)


@query("n07_model_selection")
def model_selection(t):
    """Validation macro F1, then log loss, then name decide."""
    rows = session.materialised(_matrix(t), "matrix")
    scored = None
    for name, columns in {"history": NUMERIC[:2], "objective": NUMERIC[2:], "both": NUMERIC}.items():
        out = models.logistic(rows, columns, CATEGORICAL[:1], "y_class_4", FOUR, written=True).withColumnRenamed("y_class_4", "y_true")
        part = V.with_losses(out.where(F.col("split_name") == "validation"), FOUR).withColumn("model", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    metrics = V.classification(scored, ["model"], FOUR).join(scored.groupBy("model").agg(F.avg("log_loss").alias("log_loss")), "model")
    return rounded(models.select_best(metrics, 3), 6)


def _time_split(t):
    rows = _matrix(t).withColumn("split_name", F.when(F.year("birth_date") < 1975, "train").otherwise("test"))
    out = models.logistic(rows, NUMERIC[:2], [], "y_class_4", FOUR).withColumnRenamed("y_class_4", "y_true")
    return V.with_losses(out, FOUR)


@query("n24_time_split_baseline")
def time_split_baseline(t):
    return rounded(V.classification(_time_split(t), ["split_name"], FOUR), 6)


@query(
    "n24_time_split_integrity",
    _share_sql(
        "CASE WHEN year(birth_date) < 1975 THEN 'train' ELSE 'test' END",
        "count(*) FILTER (WHERE y_class_4 = class_name) / count(*)",
    ),
    "examples",
)
def time_split_integrity(t):
    """A normalised prediction per example; at the optimum of the fit the mean probability of a class over the
    training rows is its share of them."""
    out = _by_class(_time_split(t))
    return out.withColumn("mean_p", F.when(F.col("split_name") == "train", F.round("mean_p", 3)))


def _losses(scored, by, classes):
    return V.with_losses(scored, classes).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier")
    )


@query("n26_hazard_models")
def hazard_models(t):
    """Prior and logistic hazards on person-period rows, scored by interval and split."""
    history = _wide(t).select("example_id", "history__events", "history__domains", "background__gender")
    rows = t.periods.select("person_period_id", "example_id", "split_name", "interval_index", "cutoff_age", "outcome_class").join(history, "example_id")
    rows = session.materialised(rows, "hazard")
    prior = V.interval_prior(rows, CLASSES, "outcome_class")
    fitted = models.logistic(rows, ["cutoff_age", "history__events", "history__domains"], ["interval_index", "background__gender"], "outcome_class", CLASSES, written=True)
    keep = ["split_name", "interval_index", "outcome_class", *[f"p_{c}" for c in CLASSES]]
    both = prior.select(F.lit("prior").alias("model"), *keep).unionByName(fitted.select(F.lit("logistic").alias("model"), *keep))
    return rounded(_losses(both.withColumnRenamed("outcome_class", "y_true"), ["model", "split_name", "interval_index"], CLASSES), 6)


HOLDOUTS = {
    "forward_era": lambda: M.forward_era_split(F.year("birth_date"), 1967, 1976),
    "geography": lambda: M.holdout_split(F.pmod("person_id", F.lit(5)).cast("string"), "3", "4"),
    "person_hash": lambda: M.person_hash_split(F.col("person_id")),
}


@query("n27_holdout_scenarios")
def holdout_scenarios(t):
    """One model of frozen capacity per hold-out scenario: fitted, with its class weights,
    on the scenario's own training part and scored on its validation and test parts."""
    matrix = session.materialised(_matrix(t), "holdout")
    out = None
    for name, split in HOLDOUTS.items():
        scored = models.logistic(matrix.withColumn("split_name", split()), NUMERIC, CATEGORICAL, "y_class_4", FOUR, balanced=True, written=True)
        scored = V.with_losses(scored.withColumnRenamed("y_class_4", "y_true"), FOUR)
        part = V.classification(scored, ["split_name"], FOUR).withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6)
