"""Priors, calibration metrics, cumulative incidence and person-clustered
bootstraps over prediction rows with one probability column per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.functions import vocab

EPS = 1e-15
# Weights of a Poisson(1) resample from 16 random bits: the weight is the number
# of these bounds (floor(2^16 x distribution function)) that lie at or below.
POISSON_BOUNDS = (24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535)
WORDS = 16  # 16-bit words in one sha-256 digest: replicates served by one hash


def p(name: str) -> Column:
    return F.col(f"p_{name}")


def pick(label: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def top_label(classes) -> Column:
    """First class, in order, with the greatest probability."""
    best = F.greatest(*[p(c) for c in classes])
    out = F.lit(classes[-1])
    for c in reversed(classes[:-1]):
        out = F.when(p(c) == best, c).otherwise(out)
    return out


def with_losses(rows: DataFrame, classes, label: str = "y_true") -> DataFrame:
    """Log loss, Brier score, confidence and hit per row, in separate steps so
    that each is evaluated once."""
    y = F.col(label)
    brier = sum((((p(c) - (y == c).cast("double")) ** 2) for c in classes), F.lit(0.0))
    return rows.withColumns(
        {
            "y_pred": top_label(classes),
            "log_loss": -F.log(F.greatest(pick(y, {c: p(c) for c in classes}), F.lit(EPS))),
            "brier": brier,
            "confidence": F.greatest(*[p(c) for c in classes]),
        }
    ).withColumn("hit", (F.col("y_pred") == y).cast("double"))


# --- priors and weights -----------------------------------------------------
def class_shares(rows: DataFrame, classes, by: list[str], label: str) -> DataFrame:
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(label) == c).alias(f"__{c}") for c in classes]
    )
    return counts.select(*by, *[(F.col(f"__{c}") / F.col("__n")).alias(f"p_{c}") for c in classes])


def train_prior(rows: DataFrame, classes, label: str, split: str = "split_name") -> DataFrame:
    """Class shares of the training rows on every row; scalars, not a join."""
    shares = class_shares(rows.where((F.col(split) == "train") & F.col(label).isNotNull()), classes, [], label)
    return rows.withColumns({f"p_{c}": shares.select(f"p_{c}").scalar() for c in classes})


def interval_prior(rows: DataFrame, classes, label: str, interval: str = "interval_index", split: str = "split_name") -> DataFrame:
    """Training shares per interval, the overall ones for an unseen interval.

    The intervals are a vocabulary: their shares go to the rows, which stay where they are."""
    train = rows.where(F.col(split) == "train")
    local = class_shares(train, classes, [interval], label)
    overall = class_shares(train, classes, [], label)
    joined = rows.join(F.broadcast(local), interval, "left")
    return joined.withColumns({f"p_{c}": F.coalesce(f"p_{c}", overall.select(f"p_{c}").scalar()) for c in classes})


def balanced_weights(rows: DataFrame, label: str, times: str | None = None) -> DataFrame:
    """n / (k * n_c) per class. The classes are a vocabulary: weights are
    computed on their counts and joined. A row counts as often as its column ``times`` says."""
    counts = rows.groupBy(label).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))
    everything = Window.partitionBy(F.lit(1))
    weights = counts.select(
        label, (F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight")
    )
    return rows.join(weights, label)


def align(rows: DataFrame, probabilities: str, classes) -> DataFrame:
    """Probability map to one column per class, renormalised; uniform where no
    known class has any mass."""
    raw = rows.withColumns({f"__{c}": F.coalesce(F.try_element_at(probabilities, F.lit(c)), F.lit(0.0)) for c in classes})
    total = raw.withColumn("__sum", sum((F.col(f"__{c}") for c in classes), F.lit(0.0)))
    out = total.withColumns(
        {f"p_{c}": F.when(F.col("__sum") > 0, F.col(f"__{c}") / F.col("__sum")).otherwise(1.0 / len(classes)) for c in classes}
    )
    return out.drop("__sum", *[f"__{c}" for c in classes])


# --- classification metrics -------------------------------------------------
def _number(times: str | None) -> Column:
    """Rows of a group, each as often as its column ``times`` says."""
    return F.sum(times) if times else F.count(F.lit(1))


def _mean(value, times: str | None) -> Column:
    """Mean over the rows of a group that have a value, each as often as its column ``times`` says."""
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(F.col(times) * value) / F.sum(F.when(value.isNotNull(), F.col(times))) if times else F.avg(value)


def per_class(rows: DataFrame, by: list[str], classes=None, label: str = "y_true", pred: str = "y_pred", times: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class from the class cross table.

    With ``classes`` every one of them is listed, else the union of labels seen. A row stands
    for as many as its column ``times`` says.
    """
    cross = rows.groupBy(*by, label, pred).agg(_number(times).alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(label).alias("class"), F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(zero).alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col(pred).alias("class"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    table = cross.select(*by, F.inline(sides)).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    if classes is not None:
        listed = cross.select(*by, F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")).distinct()
        table = listed.join(table, [*by, "class"], "left").na.fill(0, ["tp", "support", "predicted"])
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = table.withColumns({"precision": rate(F.col("tp"), F.col("predicted")), "recall": rate(F.col("tp"), F.col("support"))})
    f1 = rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1)


def classification(rows: DataFrame, by: list[str], classes=None, label: str = "y_true", pred: str = "y_pred", times: str | None = None) -> DataFrame:
    """Accuracy, balanced accuracy over the classes present, and macro F1."""
    return per_class(rows, by, classes, label, pred, times).groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def calibration(scored: DataFrame, by: list[str], bins: int = 10, times: str | None = None) -> DataFrame:
    """Expected calibration error of the top label; the last bin is closed."""
    slot = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    per = scored.groupBy(*by, slot.alias("bin")).agg(_number(times).alias("n"), _mean("hit", times).alias("acc"), _mean("confidence", times).alias("conf"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece_10bin"))


def interval_metrics(rows: DataFrame, by: list[str], classes=vocab.HAZARD_CLASSES, label: str = "y_true", times: str | None = None) -> DataFrame:
    """All metrics of hazard rows per group; a row stands for as many as its column ``times`` says."""
    scored = with_losses(rows, classes, label)
    happened = (F.col(label) != "no_event").cast("double")
    means = scored.groupBy(*by).agg(
        _mean("log_loss", times).alias("log_loss"),
        _mean("brier", times).alias("brier_multiclass"),
        _mean((1.0 - p("no_event") - happened) ** 2, times).alias("event_brier"),
    )
    out = classification(scored, by, classes, label, times=times).join(means, by).join(calibration(scored, by, times=times), by)
    return out.join(conditional_metrics(rows, by, label, times=times), by, "left")


def conditional_metrics(rows: DataFrame, by: list[str], label: str = "y_true", classes=vocab.EVENT_CLASSES, times: str | None = None) -> DataFrame:
    """Which event it is, given that one happened: probabilities renormalised
    over the event classes."""
    events = rows.where(F.col(label) != "no_event").withColumn("__s", sum((p(c) for c in classes), F.lit(0.0)))
    even = 1.0 / len(classes)
    cond = events.withColumns({f"p_{c}": F.when(F.col("__s") > EPS, p(c) / F.col("__s")).otherwise(even) for c in classes})
    scored = with_losses(cond, classes, label)
    loss = scored.groupBy(*by).agg(_number(times).alias("n_event"), _mean("log_loss", times).alias("conditional_log_loss"))
    f1 = classification(scored, by, classes, label, times=times).select(*by, F.col("macro_f1").alias("conditional_macro_f1"))
    return loss.join(f1, by)


# --- horizons ---------------------------------------------------------------
def cumulative_incidence(rows: DataFrame, key: list[str], classes=vocab.EVENT_CLASSES) -> DataFrame:
    """Survival and cumulative incidence after each interval, normalised.

    ``rows`` holds all intervals of each example (five of them), so the window
    is as short as the interval list.
    """
    order = Window.partitionBy(*key).orderBy("interval_index")
    stay = F.log(F.greatest(p("no_event"), F.lit(1e-300)))
    before = rows.withColumn("__s", F.exp(F.coalesce(F.sum(stay).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = before.withColumns(
        {"survival_probability": F.col("__s") * p("no_event"), **{f"__{c}": F.sum(F.col("__s") * p(c)).over(upto) for c in classes}}
    )
    total = summed.withColumn("__t", F.col("survival_probability") + sum((F.col(f"__{c}") for c in classes), F.lit(0.0)))
    return total.withColumns(
        {"p_no_event": F.col("survival_probability") / F.col("__t"), **{f"p_{c}": F.col(f"__{c}") / F.col("__t") for c in classes}}
    ).drop("__s", "__t", *[f"__{c}" for c in classes])


def horizon_truth(rows: DataFrame) -> DataFrame:
    """Whether a horizon can be judged, and its class: a known target proves the
    horizons before it event-free."""
    target = F.col("target_observable_from")
    known = target.isNotNull() | (F.col("obs_end") >= F.col("d1"))
    truth = F.when(target.isNotNull(), F.when(target <= F.col("d1"), S.class_of(F.col("target_domain"))).otherwise("no_event")).otherwise("no_event")
    return rows.withColumns({"evaluable": known, "y_true": F.when(known, truth), "horizon_years": F.col("end_year")})


# --- bootstrap --------------------------------------------------------------
def _words(hashed: DataFrame, digest: str) -> DataFrame:
    """The sixteen 16-bit words of a digest as columns ``__u0`` to ``__u15``:
    twelve hex digits are read at a time and split by shifts."""
    blocks = [F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("bigint").alias(f"__b{k}") for k in range(6)]
    read = hashed.select("*", *blocks)

    def word(i):
        # The last block holds one word only.
        shift = 0 if i == 15 else 16 * (2 - i % 3)
        return F.shiftright(f"__b{i // 3}", shift).bitwiseAND(F.lit(65535)).cast("int").alias(f"__u{i}")

    return read.select("*", *[word(i) for i in range(WORDS)])


def _weight(word: str) -> Column:
    """Poisson(1) weight of a 16-bit word; small weights are found first."""
    out = F.when(F.col(word) < POISSON_BOUNDS[0], 0)
    for k, bound in enumerate(POISSON_BOUNDS[1:], start=1):
        out = out.when(F.col(word) < bound, k)
    return out.otherwise(len(POISSON_BOUNDS))


def resampled_sums(people: DataFrame, person: str, values: list[str], reps: int, seed: str, by: list[str] = ()) -> DataFrame:
    """Weighted sums of per-person values for every replicate.

    One digest serves sixteen replicates, and the sums of a block of sixteen are
    kept side by side, so each person is spread over ``reps / 16`` rows that
    combine before the shuffle; the result is one row per group and replicate.
    """
    blocks = -(-reps // WORDS)
    spread = people.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(person).cast("string"), F.col("__block").cast("string")), 256)
    words = _words(spread.withColumn("__h", digest), "__h")
    weighted = words.select(*by, "__block", *values, *[_weight(f"__u{i}").alias(f"__w{i}") for i in range(WORDS)])
    sums = weighted.groupBy(*by, "__block").agg(
        *[F.sum(F.col(f"__w{i}") * F.col(v)).alias(f"__{v}_{i}") for i in range(WORDS) for v in values]
    )
    entries = F.array(
        *[F.struct(F.lit(i).alias("word"), *[F.col(f"__{v}_{i}").cast("double").alias(v) for v in values]) for i in range(WORDS)]
    )
    out = sums.select(*by, "__block", F.inline(entries))
    return out.withColumn("rep", F.col("__block") * WORDS + F.col("word")).where(F.col("rep") < reps).drop("__block", "word")


def paired_bootstrap(a: DataFrame, b: DataFrame, key: list[str], classes, reps: int = 1000, seed: str = "boot", by: list[str] = ()) -> DataFrame:
    """Difference of log loss and Brier of two models on the same rows, with
    person-clustered resampling. Negative favours the first."""
    keep = [*key, "person_id", "y_true", *by]
    left = with_losses(a, classes).select(*keep, F.col("log_loss").alias("__la"), F.col("brier").alias("__ba"))
    right = with_losses(b, classes).select(*key, F.col("log_loss").alias("__lb"), F.col("brier").alias("__bb"))
    people = left.join(right, key).groupBy(*by, "person_id").agg(
        F.sum(F.col("__la") - F.col("__lb")).alias("loss"), F.sum(F.col("__ba") - F.col("__bb")).alias("brier"), F.count(F.lit(1)).alias("rows")
    )
    reps_ = resampled_sums(people, "person_id", ["loss", "brier", "rows"], reps, seed, list(by)).where(F.col("rows") > 0)
    deltas = reps_.select(*by, (F.col("loss") / F.col("rows")).alias("dl"), (F.col("brier") / F.col("rows")).alias("db"))
    spread = deltas.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reps"),
        F.percentile("dl", 0.025).alias("loss_low"), F.percentile("dl", 0.975).alias("loss_high"), F.avg((F.col("dl") < 0).cast("double")).alias("loss_negative_fraction"),
        F.percentile("db", 0.025).alias("brier_low"), F.percentile("db", 0.975).alias("brier_high"), F.avg((F.col("db") < 0).cast("double")).alias("brier_negative_fraction"),
    )
    observed = people.groupBy(*by).agg(
        F.sum("rows").alias("paired_rows"), F.count(F.lit(1)).alias("paired_people"),
        (F.sum("loss") / F.sum("rows")).alias("delta_log_loss"), (F.sum("brier") / F.sum("rows")).alias("delta_brier"),
    )
    if by:
        return observed.join(spread, list(by))
    one = spread.select(F.struct("*")).scalar()
    return observed.withColumn("__s", one).select("*", "__s.*").drop("__s")


def f1_bootstrap(a: DataFrame, b: DataFrame, key: list[str], classes, reps: int = 1000, seed: str = "boot") -> DataFrame:
    """Replicates of the macro-F1 difference from per-person class counts."""
    left = a.select(*key, "person_id", "y_true", top_label(classes).alias("pa"))
    right = b.select(*key, top_label(classes).alias("pb"))
    listed = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    pairs = left.join(right, key).select("person_id", "y_true", "pa", "pb", listed)
    y, c = F.col("y_true"), F.col("class")
    # Only classes a row touches matter; the rest would add zeros.
    counts = pairs.where((y == c) | (F.col("pa") == c) | (F.col("pb") == c)).groupBy("person_id", "class").agg(
        F.count_if(y == c).alias("s"),
        F.count_if((y == c) & (F.col("pa") == c)).alias("ta"), F.count_if(F.col("pa") == c).alias("na"),
        F.count_if((y == c) & (F.col("pb") == c)).alias("tb"), F.count_if(F.col("pb") == c).alias("nb"),
    )
    sums = resampled_sums(counts, "person_id", ["s", "ta", "na", "tb", "nb"], reps, seed, ["class"])
    f1 = lambda t, n: F.coalesce(F.try_divide(2 * F.col(t), F.col("s") + F.col(n)), F.lit(0.0))
    per_rep = sums.groupBy("rep").agg(
        (F.sum(f1("ta", "na")) / len(classes)).alias("f1_a"), (F.sum(f1("tb", "nb")) / len(classes)).alias("f1_b")
    )
    d = F.col("f1_a") - F.col("f1_b")
    return per_rep.agg(
        F.count(F.lit(1)).alias("reps"),
        F.avg(d).alias("bootstrap_mean"),
        F.percentile(d, 0.025).alias("ci95_low"),
        F.percentile(d, 0.5).alias("bootstrap_median"),
        F.percentile(d, 0.975).alias("ci95_high"),
        F.avg((d > 0).cast("double")).alias("positive_fraction"),
    )


# --- integrity and ledger ---------------------------------------------------
def integrity(rows: DataFrame, key: list[str], classes) -> dict[str, DataFrame]:
    """Violating rows of interval predictions per check."""
    total = sum((p(c) for c in classes), F.lit(0.0))
    least = F.least(*[p(c) for c in classes])
    return {
        "probabilities_do_not_sum_to_one": rows.where(F.abs(total - 1) > 1e-9),
        "negative_probability": rows.where(least < 0),
        "duplicate_keys": rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1),
    }


def horizon_integrity(horizons: DataFrame, key: list[str]) -> dict[str, DataFrame]:
    """Survival never rises with the horizon; a truth exists iff it can be judged."""
    before = F.lag("survival_probability").over(Window.partitionBy(*key).orderBy("horizon_years"))
    rising = horizons.withColumn("__b", before).where(F.col("survival_probability") > F.col("__b") + 1e-12)
    return {"survival_rises": rising, "truth_without_evaluability": horizons.where(F.col("evaluable") != F.col("y_true").isNotNull())}


def ledger_outcomes(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Locked predictions against events of their domain inside the horizon; open
    where the horizon is not over and nothing happened."""
    pairs = ledger.select("prediction_id", "person_id", "domain", "cutoff", "horizon_end").join(
        events.select("person_id", "domain", "observable_from"), ["person_id", "domain"]
    ).where((F.col("observable_from") > F.col("cutoff")) & (F.col("observable_from") <= F.col("horizon_end")))
    hits = pairs.groupBy("prediction_id").agg(F.min("observable_from").alias("resolved_by"))
    joined = ledger.where("locked").join(hits, "prediction_id", "left")
    outcome = F.when(F.col("resolved_by").isNotNull(), 1).when(F.col("horizon_end") <= F.col("obs_end"), 0)
    return joined.withColumn("outcome", outcome).withColumn("brier", (F.col("probability") - F.col("outcome")) ** 2)
