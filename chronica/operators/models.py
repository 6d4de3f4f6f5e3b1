"""Probabilistic models with Spark ML: fitted on train rows, scored everywhere,
returned as one probability column per class."""

from __future__ import annotations

from bisect import bisect_right
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica import session
from chronica.operators import evaluation, scale

# Boosting capacities (fixed values): rounds, step and smallest leaf. The depth is the
# one whose full tree has the reference's number of leaves (15, 31, 63) and one more.
CAPACITIES = {
    "small": {"trees": 250, "depth": 4, "step": 0.05, "leaf": 30},
    "medium": {"trees": 350, "depth": 5, "step": 0.05, "leaf": 25},
    "large": {"trees": 450, "depth": 6, "step": 0.04, "leaf": 20},
}
# Different values of all columns whose counts are read for medians; beyond, ranks are found by Spark jobs.
MOST_VALUES = 1 << 16
# Different training rows that ensembles are grown from in one task each; beyond, by Spark ML.
MOST_CELLS = 1 << 16
# Rounds allowed to the logistic solver (fixed value); it has to converge before.
LOGISTIC_ROUNDS = 5000


def variant_columns(columns: list[str], variants: dict[str, tuple]) -> dict[str, list[str]]:
    """Columns of each feature variant, by prefix."""
    return {name: [c for c in columns if c.startswith(tuple(prefixes))] for name, prefixes in variants.items()}


def preprocessor(numeric: list[str], categorical: list[str], scaled: list[str] = ()) -> Pipeline:
    """Scaling of numbers without gaps, unless they are ``scaled``; categories one-hot, unseen ones kept apart."""
    stages = []
    parts = list(scaled)
    if numeric:
        stages.append(VectorAssembler(inputCols=numeric, outputCol="__num"))
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="__num", outputCol="__scaled"))
        parts.append("__scaled")
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"__s_{c}" for c in categorical], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"__s_{c}" for c in categorical], outputCols=[f"__h_{c}" for c in categorical], handleInvalid="keep", dropLast=False))
        parts += [f"__h_{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


def _cast(rows: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    return rows.withColumns(
        {**{c: F.col(c).cast("double") for c in numeric}, **{c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in categorical}}
    )


def medians(rows: DataFrame, numeric: list[str], times: str | None = None) -> dict[str, float]:
    """Exact medians of columns in one selection; a column without any value gets 0. A row stands for as many
    as its column ``times`` says."""
    weight = F.col(times) if times else F.lit(1)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in numeric]))
    long = rows.select(each.alias("e"), weight.alias("__times")).select("e.name", "e.v", "__times")
    counts = long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("name", (F.col("v") + 0.0).alias("v")).agg(F.sum("__times").alias("n"))
    few = counts.limit(MOST_VALUES + 1).collect()
    if len(few) > MOST_VALUES:
        found = {r["name"]: r["median"] for r in scale.medians(long, ["name"], "v", times="__times").collect()}
    else:
        found = {}
        for c in {r["name"] for r in few}:
            values, times = zip(*sorted((r["v"], r["n"]) for r in few if r["name"] == c))
            upto = list(accumulate(times))
            low, high = (values[bisect_right(upto, k)] for k in ((upto[-1] - 1) // 2, upto[-1] // 2))
            found[c] = (low + high) / 2
    return {c: found.get(c, 0.0) for c in numeric}


def prepared(rows: DataFrame, numeric, categorical, split: str = "split_name") -> DataFrame:
    """All rows with features: gaps filled with the training rows' medians, numbers scaled and
    categories coded as in training."""
    ready = _cast(rows, numeric, categorical)
    train = F.col(split) == "train"
    if numeric:
        ready = ready.na.fill(medians(ready.where(train), list(numeric)))
    return preprocessor(numeric, categorical).fit(ready.where(train)).transform(ready)


def _code(label: str, classes):
    return F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("double") - 1


def _columns(scored: DataFrame, keep: list[str], classes, vector: str = "probability") -> DataFrame:
    p = vector_to_array(vector)
    return scored.select(*keep, *[F.get(p, F.lit(i)).alias(f"p_{c}") for i, c in enumerate(classes)])


def folded(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows that agree in the columns as one, with their number ``__n``; written."""
    return session.materialised(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), "folded")


def scaling(cells: DataFrame, numeric: list[str], times: str) -> dict[str, Column]:
    """Columns less their means, by their deviations over all rows that the cells stand for; a constant is 0."""
    if not numeric:
        return {}
    n = F.col(times)
    first = cells.agg(F.sum(n).alias("n"), *[(F.sum(n * F.col(c)) / F.sum(n)).alias(c) for c in numeric]).first()
    spread = cells.agg(*[F.sum(n * (F.col(c) - F.lit(first[c])) ** 2).alias(c) for c in numeric]).first()
    by = {c: ((first["n"] - 1) / spread[c]) ** 0.5 if spread[c] else 0.0 for c in numeric}
    return {c: (F.col(c) - F.lit(first[c])) * F.lit(by[c]) for c in numeric}


def with_scores(rows: DataFrame, keys: list[str], score) -> DataFrame:
    """Rows with what ``score`` adds to their distinct keys, which are written. Missing and not-a-number keys
    meet their equals."""
    return attached(rows, keys, session.materialised(score(rows.select(*keys).distinct()), "scores"))


def attached(rows: DataFrame, keys: list[str], scored: DataFrame) -> DataFrame:
    """Rows with the other columns of a table that has each of their keys once."""
    same = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in keys]
    extra = [c for c in scored.columns if c not in keys]
    if not same:
        return rows.crossJoin(scored)
    joined = rows.alias("__l").join(scored.alias("__r"), reduce(Column.__and__, same), "left")
    return joined.select(*[F.col(f"__l.{c}") for c in rows.columns], *[F.col(f"__r.{c}") for c in extra])


def logistic(rows: DataFrame, numeric, categorical, label: str, classes, balanced: bool = False, c: float = 1.0, split: str = "split_name", written: bool = False) -> DataFrame:
    """Multinomial logistic regression with an L2 penalty of 1 / (C n).

    The rows are written as they are (unless ``written``), never with their feature vectors."""
    table = rows if written else session.materialised(rows, "matrix")
    return logistic_model(table, numeric, categorical, label, classes, balanced, c, split)(table)


def logistic_model(table: DataFrame, numeric, categorical, label: str, classes, balanced: bool = False, c: float = 1.0, split: str = "split_name"):
    """The fit to the training rows of a table, as a function that adds p_<class> to any rows with its columns.

    Rows that agree in features and label are one row with their number as weight, which has the same
    optimum; scaling, the solver's rounds and the scores need the distinct ones only."""
    numeric, categorical, classes = list(numeric), list(categorical), list(classes)
    keys = [f"__f{i}" for i in range(len(numeric) + len(categorical))]
    named = [F.col(n).alias(k) for n, k in zip([*numeric, *categorical], keys)]
    numbers, texts = keys[: len(numeric)], keys[len(numeric) :]
    train = _cast(table.select(*named, split, F.col(label).alias("__label")), numbers, texts).where(F.col(split) == "train")
    cells = folded(train, [*keys, "__label"])
    middle = medians(cells, numbers, "__n") if numbers else {}
    filled = lambda df: df.na.fill(middle) if middle else df
    scale_by = scaling(filled(cells), numbers, "__n")
    scaled = lambda df: filled(df).withColumns({f"__z{k}": v for k, v in scale_by.items()}) if scale_by else filled(df)
    how = preprocessor([], texts, [f"__z{k}" for k in numbers]).fit(scaled(cells))
    known = how.transform(scaled(cells.where(F.col("__label").isNotNull()))).withColumn("__y", _code("__label", classes))
    if balanced:
        known = evaluation.balanced_weights(known, "__label", "__n")
    else:
        known = known.withColumn("weight", F.lit(1.0))
    known = known.withColumn("weight", F.col("weight") * F.col("__n"))
    total = known.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(
        family="multinomial", featuresCol="features", labelCol="__y", weightCol="weight",
        regParam=1.0 / (c * total), standardization=False, maxIter=LOGISTIC_ROUNDS,
    ).fit(known)
    if model.summary.totalIterations >= LOGISTIC_ROUNDS:
        raise RuntimeError(f"logistic regression has not converged in {LOGISTIC_ROUNDS} rounds")

    def score(distinct: DataFrame) -> DataFrame:
        raw = distinct.select("*", *[F.col(k).alias(f"__k{k}") for k in keys])
        scored = _columns(model.transform(how.transform(scaled(raw))), [f"__k{k}" for k in keys], classes[: model.numClasses])
        return scored.withColumnsRenamed({f"__k{k}": k for k in keys})

    def add(rows: DataFrame) -> DataFrame:
        out = with_scores(_cast(rows.select("*", *named), numbers, texts), keys, score)
        for missing in classes[model.numClasses:]:
            out = out.withColumn(f"p_{missing}", F.lit(0.0))
        return out.select(*rows.columns, *[f"p_{x}" for x in classes])

    return add


def boosted(rows: DataFrame, numeric, categorical, label: str, classes, trees: int, depth: int, step: float, leaf: int, split: str = "split_name", most_cells: int = MOST_CELLS) -> DataFrame:
    """One boosted ensemble per class against the rest, probabilities
    renormalised: an approximation of multi-class boosting, which Spark ML lacks.

    The matrix is written once, so that no round repeats the joins behind it. Rows that agree in
    features and label are one with their number: where these are few the ensembles are grown in tasks
    (``ensembles``), else by Spark ML with the numbers as weights. Scores are made once per distinct
    row of features.
    """
    from chronica.operators import ensembles

    keep, numeric, categorical, classes = rows.columns, list(numeric), list(categorical), list(classes)
    table = session.materialised(rows, "matrix")
    keys = [f"__f{i}" for i in range(len(numeric) + len(categorical))]
    numbers, texts = keys[: len(numeric)], keys[len(numeric) :]
    named = [F.col(n).alias(k) for n, k in zip([*numeric, *categorical], keys)]
    train = _cast(table.select(*named, split, F.col(label).cast("string").alias("__label")), numbers, texts).where(F.col(split) == "train")
    cells = folded(train, [*keys, "__label"])
    middle = medians(cells, numbers, "__n") if numbers else {}
    filled = lambda df: df.na.fill(middle) if middle else df
    known = filled(cells.where(F.col("__label").isNotNull()))
    present = {r[0] for r in known.select("__label").distinct().collect()}
    wanted = [c for c in classes if c in present]
    few = known.limit(most_cells + 1).count() <= most_cells
    if few:
        found = sorted(known.select(*keys, "__label", "__n").collect())
        kinds = [pa.field(k, pa.float64()) for k in numbers] + [pa.field(k, pa.string()) for k in [*texts, "__label"]] + [pa.field("__n", pa.int64())]
        batch = pa.RecordBatch.from_pylist([r.asDict() for r in found], schema=pa.schema(kinds))
        plain = lambda names: [k.removeprefix("__") for k in names]
        how = ensembles.binning(batch, plain(numbers), plain(texts), {k.removeprefix("__"): v for k, v in middle.items()})
        grown = ensembles.fit(rows.sparkSession, batch, how, "__label", wanted, trees=trees, depth=depth, step=step, leaf=leaf)
        score = lambda distinct: ensembles.score(distinct, how, grown, classes)
    else:
        score = _spark_boosted(known, filled, numbers, texts, keys, classes, wanted, trees, depth, step, leaf)
    features = _cast(table.select("*", *named), numbers, texts)
    out = with_scores(features, keys, score)
    probabilities = F.create_map(*[x for c in classes for x in (F.lit(c), F.col(f"__p_{c}"))])
    return evaluation.align(out.select(*keep, probabilities.alias("__m")), "__m", classes).drop("__m")


def _spark_boosted(known: DataFrame, filled, numbers, texts, keys, classes, wanted, trees: int, depth: int, step: float, leaf: int):
    """Spark ML's ensembles over cells, fitted side by side. A leaf's least number of rows is a share of their weight."""
    how = preprocessor(numbers, texts).fit(known)
    ready = session.materialised(how.transform(known).select("features", "__label", F.col("__n").cast("double").alias("weight")), "cells")
    total = ready.agg(F.sum("weight")).first()[0]

    def fitted(c):
        booster = GBTClassifier(
            featuresCol="features", labelCol="__y", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=step,
            minInstancesPerNode=1, minWeightFractionPerNode=min((leaf - 0.5) / total, 0.499), seed=20261006,
        )
        return booster.fit(ready.withColumn("__y", (F.col("__label") == c).cast("double")))

    with ThreadPoolExecutor(max(1, len(wanted))) as pool:
        ensembles = dict(zip(wanted, pool.map(fitted, wanted)))

    def score(distinct: DataFrame) -> DataFrame:
        kept = [f"__k{k}" for k in keys]
        out = how.transform(filled(distinct.select("*", *[F.col(k).alias(n) for k, n in zip(keys, kept)]))).select(*kept, "features")
        for c in classes:
            if c not in ensembles:
                out = out.withColumn(f"__p_{c}", F.lit(0.0))
                continue
            scored = ensembles[c].transform(out).withColumn(f"__p_{c}", F.get(vector_to_array("probability"), F.lit(1)))
            out = scored.drop("rawPrediction", "probability", "prediction")
        return out.drop("features").withColumnsRenamed(dict(zip(kept, keys)))

    return score


def select_best(metrics: DataFrame, k: int = 1) -> DataFrame:
    """Best models: macro F1, then log loss, then name."""
    return metrics.orderBy(F.desc("macro_f1"), F.asc("log_loss"), F.asc("model")).limit(k)
