"""Queries: jointly boosted models, selection of a capacity, fitted hazards to horizons, hold-outs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from chronica import session
from chronica.functions import vocab
from chronica.operators import boosting, models
from chronica.operators import evaluation as V
from chronica.operators import training as M
from chronica.plans import binding
from chronica.plans.evaluation import HOLDOUTS, VARIANTS, _matrix, _wide, rounded
from chronica.plans.registry import query

FOUR = vocab.CLASSES_4
CLASSES = vocab.HAZARD_CLASSES
TEXTS = ("background__gender", "calendar__month")
REAL = [v for v in VARIANTS if v != "placebo"]
# The capacity that later scenarios keep (fixed by the protocol).
FROZEN = "small"


def features(columns: list[str], variant: str) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns of a feature variant; the cutoff age is in all."""
    used = models.variant_columns(columns, VARIANTS)[variant]
    return ["cutoff_age", *[c for c in used if c not in TEXTS]], [c for c in used if c in TEXTS]


def eligible(rows, variant: str):
    """Rows a variant may use: the placebo needs a donor."""
    return rows.where("placebo__branch IS NOT NULL") if variant == "placebo" else rows


def trained(rows, variant: str, label: str, classes):
    numeric, categorical = features(rows.columns, variant)
    train = eligible(rows, variant).where((F.col("split_name") == "train") & F.col(label).isNotNull())
    return boosting.training(train, numeric, categorical, label, classes)


def predictions(t):
    """Every variant's probabilities by the frozen capacity, kept for the queries below."""

    def make():
        rows = session.materialised(_matrix(t), "matrix")
        data = {v: trained(rows, v, "y_class_4", FOUR) for v in VARIANTS}
        fitted = boosting.fit_grid(data, {FROZEN: boosting.CAPACITIES[FROZEN]}, balanced=True)
        out = None
        for v in VARIANTS:
            part = boosting.predict(fitted[v, FROZEN], eligible(rows, v), FOUR)
            part = part.select(F.lit(v).alias("feature_variant"), "example_id", "person_id", "split_name", F.col("y_class_4").alias("y_true"), *[f"p_{c}" for c in FOUR])
            out = part if out is None else out.unionByName(part)
        return out

    return t.stage("boosted_predictions", make)


@query("n06_joint_boosting")
def joint_boosting(t):
    """Metrics of one softmax model per feature variant, boosted jointly over the classes."""
    scored = V.with_losses(predictions(t), FOUR)
    by = ["feature_variant", "split_name"]
    losses = scored.groupBy(*by).agg(F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier_multiclass"))
    return rounded(V.classification(scored, by, FOUR).join(losses, by).join(V.calibration(scored, by), by), 6)


@query(
    "n06_joint_integrity",
    "SELECT v.feature_variant, e.split_name, count(*) AS n, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS not_normalised, CAST(0 AS BIGINT) AS outside, true AS beats_prior "
    f"FROM examples e, (VALUES {', '.join(f'({chr(39)}{v}{chr(39)})' for v in VARIANTS)}) v(feature_variant) "
    "WHERE classification_eligible AND (v.feature_variant <> 'placebo' OR person_id % 4 > 0) GROUP BY 1, 2",
    "examples",
)
def joint_integrity(t):
    """A prediction per eligible example and variant, normalised, and training rows fitted better than by the
    classes' even shares, which is where balanced weights start."""
    scored = V.with_losses(predictions(t), FOUR)
    train = scored.where("split_name = 'train'").groupBy("feature_variant", "y_true").agg(F.avg("log_loss").alias("l"))
    fit = train.groupBy("feature_variant").agg((F.avg("l") < F.log(F.count(F.lit(1)).cast("double")) + 1e-9).alias("beats_prior"))
    total = sum((V.p(c) for c in FOUR), F.lit(0.0))
    bad = F.greatest(*[F.when(V.p(c).between(0, 1), 0).otherwise(1) for c in FOUR]) == 1
    out = scored.groupBy("feature_variant", "split_name").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - F.count_distinct("example_id")).alias("duplicates"),
        F.count_if(F.abs(total - 1) > 1e-9).alias("not_normalised"),
        F.count_if(bad).alias("outside"),
    )
    return out.join(fit, "feature_variant")


def selection(scored, candidates: list[str]):
    """Candidates in order: mean validation macro F1 over the variants, then mean log loss, then their own
    order. ``scored`` has model, feature_variant and losses of validation rows only."""
    by = ["model", "feature_variant"]
    losses = scored.groupBy(*by).agg(F.avg("log_loss").alias("log_loss"))
    each = V.classification(scored, by, FOUR).join(losses, by)
    means = each.groupBy("model").agg(F.avg("macro_f1").alias("mean_macro_f1"), F.avg("log_loss").alias("mean_log_loss"), F.count(F.lit(1)).alias("variants"))
    order = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("model")).cast("int")
    ranked = rounded(means.withColumn("candidate_order", order), 9)
    place = F.struct(-F.col("mean_macro_f1"), F.col("mean_log_loss"), F.col("candidate_order"))
    rows = ranked.agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), *ranked.columns))).alias("all"))  # a row per candidate
    return rows.select(F.posexplode("all").alias("at", "c")).select((F.col("at") + 1).alias("rank"), *[F.col(f"c.{c}").alias(c) for c in ranked.columns])


@query("n07_capacity_selection")
def capacity_selection(t):
    """Three capacities by validation rows of the four real variants; test rows are never scored. Each
    variant is folded once for all capacities."""
    rows = session.materialised(_matrix(t).where("split_name <> 'test'"), "selection")
    data = {v: trained(rows, v, "y_class_4", FOUR) for v in REAL}
    fitted = boosting.fit_grid(data, boosting.CAPACITIES, balanced=True)
    validation = rows.where("split_name = 'validation'")
    scored = None
    for (variant, capacity), model in sorted(fitted.items()):
        part = boosting.predict(model, validation, FOUR).withColumnRenamed("y_class_4", "y_true")
        part = V.with_losses(part, FOUR).withColumns({"model": F.lit(capacity), "feature_variant": F.lit(variant)})
        scored = part if scored is None else scored.unionByName(part)
    return selection(scored, list(boosting.CAPACITIES))


@query("n27_holdout_boosting")
def holdout_boosting(t):
    """The frozen capacity, fitted anew with its class weights on each scenario's training part, for every
    real variant; nothing is selected."""
    matrix = session.materialised(_matrix(t), "holdout")
    data, parts = {}, {}
    for name, split in HOLDOUTS.items():
        parts[name] = matrix.withColumn("split_name", split())
        for v in REAL:
            data[f"{name}|{v}"] = trained(parts[name], v, "y_class_4", FOUR)
    fitted = boosting.fit_grid(data, {FROZEN: boosting.CAPACITIES[FROZEN]}, balanced=True)
    out = None
    for (key, _), model in sorted(fitted.items()):
        name, variant = key.split("|")
        rows = parts[name].where("split_name <> 'train'")
        part = V.with_losses(boosting.predict(model, rows, FOUR).withColumnRenamed("y_class_4", "y_true"), FOUR)
        part = part.select(F.lit(name).alias("scenario"), F.lit(variant).alias("feature_variant"), "split_name", "y_true", "y_pred", "log_loss")
        out = part if out is None else out.unionByName(part)
    by = ["scenario", "feature_variant", "split_name"]
    losses = out.groupBy(*by).agg(F.avg("log_loss").alias("log_loss"))
    return rounded(V.classification(out, by, FOUR).join(losses, by), 6)


# --- hazards ----------------------------------------------------------------
FAMILIES = ("interval_prior", "multinomial_logistic", "boosting")


ARM = ["model_family", "feature_variant"]
KEEP = ["person_period_id", "example_id", "person_id", "split_name", "interval_index", "end_year", "d1", "obs_end", "target_observable_from", "target_domain", "outcome_class"]
FEATURES = ["cutoff_age", "history__events", "history__domains", "background__gender", "calendar__month", "chart__branch", "placebo__branch"]
PROBABILITIES = [f"p_{c}" for c in CLASSES]


def _used(variant: str) -> list[str]:
    """Feature columns of a variant of the hazards; the prior has none."""
    return [] if variant == "interval_only" else [c for part in features(FEATURES, variant) for c in part]


def _arms() -> list[tuple[str, str]]:
    return [(FAMILIES[0], "interval_only"), *[(f, v) for v in VARIANTS for f in (FAMILIES[2], FAMILIES[1])]]


def _hazard_examples(t):
    """Examples with their features, outcome and the number of rows that have the same id: where it is
    theirs alone, all that is said of an example is in its row."""

    def make():
        rows = _wide(t, "cutoff", "obs_end", "death_year", "target_observable_from", "target_domain", "censor_aware_eligible")
        return rows.where("example_id IS NOT NULL").withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("example_id")))

    return t.stage("hazard_examples", make)


def _numbered(rows):
    return rows.withColumn("person_period_id", F.col("example_id") * 10 + F.col("interval_index"))


def _single_rows(t):
    """All intervals of the examples whose id no other has, spread from their rows."""
    rows = M.interval_outcomes(_hazard_examples(t).where("copies = 1"), binding.SNAPSHOT_CUTOFF)
    return _numbered(rows).select(*KEEP, *FEATURES)


def _repeated_rows(t):
    """All intervals of examples that share an id: every row meets every outcome and all features of its id. None
    where there are no such examples."""

    def make():
        some = _hazard_examples(t).where("copies > 1")
        at_risk = _numbered(M.person_period(some, binding.SNAPSHOT_CUTOFF)).select("person_period_id", "outcome_class")
        grid = _numbered(M.interval_grid(some.where("censor_aware_eligible"), "cutoff")).join(at_risk, "person_period_id", "left")
        return grid.select(*KEEP, FEATURES[0]).join(some.select("example_id", *FEATURES[1:]), "example_id").select(*KEEP, *FEATURES)

    rows = t.stage("hazard_repeated", make)
    return None if rows.isEmpty() else rows


def _hazard_rows(t):
    repeated, rows = _repeated_rows(t), _single_rows(t)
    return rows if repeated is None else rows.unionByName(repeated)


def _hazard_scores(t):
    """Probabilities of every family and variant for its distinct features at every interval; features that a variant
    does not use are missing.

    Models are fitted on the intervals at risk of training people, and say what the intervals beyond would
    hold: that is what survival to a horizon is composed of."""

    def make():
        rows = _hazard_rows(t)
        kinds = dict(rows.dtypes)

        def name(part, family, variant):
            used = _used(variant)
            seen = [F.col(c) if c in used else F.lit(None).cast(kinds[c]).alias(c) for c in FEATURES]
            return part.select(F.lit(family).alias("model_family"), F.lit(variant).alias("feature_variant"), *seen, "interval_index", *PROBABILITIES)

        known = F.when(F.col("outcome_class").isNotNull(), F.col("split_name"))
        prior = V.interval_prior(rows.withColumn("__known", known), CLASSES, "outcome_class", split="__known")
        out = name(prior.select("interval_index", *PROBABILITIES).distinct(), *_arms()[0])
        data, columns = {}, {}
        for v in VARIANTS:
            numeric, categorical = features(FEATURES, v)
            columns[v] = ([*numeric, "interval_index"], categorical)
            train = eligible(rows, v).where("split_name = 'train' AND outcome_class IS NOT NULL")
            data[v] = boosting.training(train, *columns[v], "outcome_class", CLASSES)
        fitted = boosting.fit_grid(data, {FROZEN: boosting.CAPACITIES[FROZEN]})
        for v in VARIANTS:
            mine = eligible(rows, v)
            points = session.materialised(mine.select(*_used(v), "interval_index").distinct(), "points")
            out = out.unionByName(name(boosting.predict(fitted[v, FROZEN], points, CLASSES), FAMILIES[2], v))
            numeric, categorical = columns[v][0][:-1], [*columns[v][1], "interval_index"]
            logistic = models.logistic_model(mine, numeric, categorical, "outcome_class", CLASSES)
            out = out.unionByName(name(logistic(points), FAMILIES[1], v))
        return out

    return t.stage("hazard_scores", make)


def _predicted(rows, scores):
    """Rows with the probabilities of every family and variant."""
    out = None
    for family, variant in _arms():
        keys = [*_used(variant), "interval_index"]
        mine = scores.where((F.col("model_family") == family) & (F.col("feature_variant") == variant)).select(*ARM, *keys, *PROBABILITIES)
        part = models.attached(eligible(rows, variant), keys, mine).select(*ARM, *KEEP, *PROBABILITIES)
        out = part if out is None else out.unionByName(part)
    return out


def hazards(t):
    """Probabilities of every family and variant on all intervals of all cutoffs, kept for the queries below."""
    return t.stage("hazard_predictions", lambda: _predicted(_hazard_rows(t), _hazard_scores(t)))


@query("n26_hazard_intervals")
def hazard_intervals(t):
    """Interval metrics of every family and variant on the held-out rows at risk."""
    rows = hazards(t).where("outcome_class IS NOT NULL AND split_name <> 'train'").withColumnRenamed("outcome_class", "y_true")
    return rounded(V.interval_metrics(rows, [*ARM, "split_name"]), 6)


def _horizons(t):
    return V.horizon_truth(V.cumulative_incidence(hazards(t), [*ARM, "example_id"]))


def _horizon_cells(t):
    """What :func:`_horizons` says of the held-out rows that can be judged, rows that agree in features, horizon
    and truth as one with their number ``__n``.

    Hazards to a horizon are composed once per distinct features. Examples that share an id are composed
    row by row."""
    columns = [*ARM, "split_name", "horizon_years", "y_true", *PROBABILITIES]
    judged = "evaluable AND split_name <> 'train'"
    scores = _hazard_scores(t)
    curves = V.cumulative_incidence(scores, [*ARM, *FEATURES])
    rows = V.horizon_truth(_single_rows(t)).where(judged)
    cells = None
    for v in ["interval_only", *VARIANTS]:
        used = _used(v)
        part = eligible(rows, v).groupBy(*used, "interval_index", "split_name", "horizon_years", "y_true").agg(F.count(F.lit(1)).alias("__n"))
        missing = [F.lit(None).cast(kind).alias(c) for c, kind in scores.dtypes if c in FEATURES and c not in used]
        part = part.select("*", F.lit(v).alias("feature_variant"), *missing)
        cells = part if cells is None else cells.unionByName(part)
    keys = ["feature_variant", *FEATURES, "interval_index"]
    met = cells.alias("c").join(curves.alias("s"), reduce(Column.__and__, [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]))
    sides = {"feature_variant": "c", "split_name": "c", "horizon_years": "c", "y_true": "c"}
    out = met.select(*[F.col(f"{sides.get(c, 's')}.{c}") for c in columns], "c.__n")
    repeated = _repeated_rows(t)
    if repeated is not None:
        each = V.horizon_truth(V.cumulative_incidence(_predicted(repeated, scores), [*ARM, "example_id"]))
        out = out.unionByName(each.where(judged).select(*columns, F.lit(1).cast("bigint").alias("__n")))
    return session.materialised(out, "horizons")


@query("n26_hazard_horizons")
def hazard_horizons(t):
    """Survival and cumulative incidence of the fitted hazards, scored at each horizon that can be judged."""
    out = V.interval_metrics(_horizon_cells(t), [*ARM, "split_name", "horizon_years"], times="__n")
    return rounded(out.drop("n_event", "conditional_log_loss", "conditional_macro_f1"), 6)


@query("n26_hazard_bootstrap")
def hazard_bootstrap(t):
    """Boosting on the history against the prior: paired, by person, on fitted probabilities."""
    test = hazards(t).where("outcome_class IS NOT NULL AND split_name = 'test'").withColumnRenamed("outcome_class", "y_true")
    a = test.where("model_family = 'boosting' AND feature_variant = 'history'")
    b = test.where("model_family = 'interval_prior'")
    return rounded(V.paired_bootstrap(a, b, ["person_period_id"], CLASSES, reps=1000), 8)


_ARMS_SQL = " UNION ALL ".join(
    ["SELECT 'interval_prior' AS model_family, 'interval_only' AS feature_variant"]
    + [f"SELECT '{f}', '{v}'" for f in FAMILIES[1:] for v in VARIANTS]
)


@query(
    "n26_hazard_integrity",
    f"""WITH arms AS ({_ARMS_SQL}), g AS (SELECT e.example_id, e.person_id, e.split_name, e.example_id * 10 + i AS person_period_id, target_observable_from IS NOT NULL OR obs_end >= CAST(cutoff + to_years(CAST(y AS INTEGER)) AS DATE) AS judged
  FROM examples e, (VALUES (0, 1), (1, 3), (2, 5), (3, 10), (4, 20)) v(i, y) WHERE censor_aware_eligible)
SELECT model_family, feature_variant, g.split_name, count(*) AS n, count(p.person_period_id) AS at_risk, count(*) FILTER (WHERE judged) AS evaluable,
  CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS not_normalised, CAST(0 AS BIGINT) AS survival_rises, CAST(0 AS BIGINT) AS truth_without_evaluability
FROM arms, g LEFT JOIN periods p ON p.person_period_id = g.person_period_id WHERE feature_variant <> 'placebo' OR g.person_id % 4 > 0 GROUP BY 1, 2, 3""",
    "examples periods",
)
def hazard_integrity(t):
    """Every arm covers every interval once, composes to survival that never rises, and judges what can be."""
    horizons = _horizons(t)
    total = sum((V.p(c) for c in CLASSES), F.lit(0.0))
    by = [*ARM, "split_name"]
    checks = V.horizon_integrity(horizons, [*ARM, "example_id"])
    wrong = [checks[c].groupBy(*by).agg(F.count(F.lit(1)).alias(c)) for c in ("survival_rises", "truth_without_evaluability")]
    out = horizons.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("outcome_class").alias("at_risk"),
        F.count_if("evaluable").alias("evaluable"),
        (F.count(F.lit(1)) - F.count_distinct("person_period_id")).alias("duplicates"),
        F.count_if(F.abs(total - 1) > 1e-9).alias("not_normalised"),
    )
    for part in wrong:
        out = out.join(part, by, "left")
    return out.na.fill(0)
