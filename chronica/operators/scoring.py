"""Additive log-odds score card over answers and past events, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions import vocab

SHARES = ("wood", "fire", "earth", "metal", "water")


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.08), F.least(F.lit(0.92), x))


def prior(shares: dict[str, Column]) -> dict[str, Column]:
    """Prior trait scores from element shares."""
    return {
        "exploration": _clamp(F.lit(0.35) + (shares["water"] + shares["wood"]) * 0.50 / 2),
        "execution": _clamp(F.lit(0.28) + shares["fire"] * 0.72),
        "structure": _clamp(F.lit(0.30) + shares["metal"] * 0.70),
        "stability": _clamp(F.lit(0.30) + shares["earth"] * 0.70),
        "expression": _clamp(F.lit(0.30) + shares["fire"] * 0.42 + shares["wood"] * 0.28),
    }


def _shift(score: Column, delta: Column) -> Column:
    """Move a probability by a log-odds delta."""
    logit = F.log(score / (1 - score)) + delta
    return _clamp(1 / (1 + F.exp(-logit)))


def answer_delta(trait: str) -> Column:
    total = F.lit(0.0)
    for (question, answer), deltas in vocab.ANSWER_DELTAS.items():
        if trait in deltas:
            total = total + F.when(F.col(question) == answer, deltas[trait]).otherwise(0.0)
    for scale, deltas in vocab.SCALE_DELTAS.items():
        if trait in deltas:
            total = total + (F.col(scale) - 3) * deltas[trait]
    return total


def event_deltas(events: DataFrame) -> DataFrame:
    """Summed deltas per person; one conditional sum per trait combines early."""
    early = F.when((F.col("age_mid") <= vocab.EARLY_AGE) & (F.col("domain") == "migration"), vocab.EARLY_FACTOR).otherwise(1.0)

    def total(trait):
        part = F.lit(0.0)
        for domain, deltas in vocab.PAST_EVENT_DELTAS.items():
            if trait in deltas:
                step = F.lit(deltas[trait]) * early if (domain, trait) == ("migration", "exploration") else F.lit(deltas[trait])
                part = part + F.when(F.col("domain") == domain, step).otherwise(0.0)
        return F.sum(part).alias(f"d_{trait}")

    return events.groupBy("person_id").agg(*[total(t) for t in vocab.TRAITS])


def trait_scores(answers: DataFrame, events: DataFrame) -> DataFrame:
    """Prior, shifted by the answers, shifted by the past events."""
    joined = answers.join(event_deltas(events), "person_id", "left")
    total = F.greatest(sum((F.col(s) for s in SHARES), F.lit(0)), F.lit(1))
    start = prior({s: F.col(s) / total for s in SHARES})
    out = {}
    for trait in vocab.TRAITS:
        answered = _shift(start[trait], answer_delta(trait))
        out[trait] = _shift(answered, F.coalesce(f"d_{trait}", F.lit(0.0)))
    return joined.select("person_id", *[c.alias(t) for t, c in out.items()])


def rounded(scores: DataFrame, digits: int = 7) -> DataFrame:
    return scores.select("person_id", *[F.round(t, digits).alias(t) for t in vocab.TRAITS])


def branch_shares(scores: DataFrame) -> DataFrame:
    """Linear branch scores as shares of their sum, ranked."""
    raw = {}
    for name, (constant, weights) in vocab.BRANCHES.items():
        value = F.lit(constant)
        for trait, weight in weights.items():
            value = value + F.col(trait) * weight
        raw[name] = value
    total = sum(raw.values(), F.lit(0.0))
    shares = {n: v / total for n, v in raw.items()}
    # Four branches per person: the rank is a count over a fixed array, no window.
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("branch"),
                s.alias("share"),
                sum(((o > s).cast("int") for m, o in shares.items() if m != n), F.lit(1)).alias("rank"),
            )
            for n, s in shares.items()
        ]
    )
    return scores.select("person_id", F.inline(entries))


# --- sample answers ---------------------------------------------------------
PRESSURE = ("research", "act", "avoid", "ask")
MODES = ("system", "prototype", "switch", "steady")
FEARS = ("money", "direction", "status", "relationship", "wasted")


def sample_answers(persons: DataFrame) -> DataFrame:
    key = F.col("person_id")

    def pick(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (key % by % len(values) + 1).cast("int"))

    return persons.select(
        "person_id",
        *[(F.floor(key / (i + 1)) % 4).alias(s) for i, s in enumerate(SHARES)],
        pick(PRESSURE, 4).alias("under_pressure"),
        pick(MODES, 7).alias("project_mode"),
        pick(FEARS, 5).alias("biggest_fear"),
        (key % 5 + 1).alias("consistency"),
        (key % 6).alias("mobility"),
    )


def _sql_sum(parts: list[str]) -> str:
    return " + ".join(parts) if parts else "0.0::DOUBLE"


def trait_scores_sql(rounded_out: bool = True) -> str:
    def case(values, by):
        return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST(person_id % {by} % {len(values)} + 1 AS INTEGER)]"

    shares = ", ".join(f"((person_id // {i + 1}) % 4)::DOUBLE AS {s}" for i, s in enumerate(SHARES))
    start = {
        "exploration": "0.35::DOUBLE + (water + wood) / tot * 0.5::DOUBLE / 2",
        "execution": "0.28::DOUBLE + fire / tot * 0.72::DOUBLE",
        "structure": "0.30::DOUBLE + metal / tot * 0.70::DOUBLE",
        "stability": "0.30::DOUBLE + earth / tot * 0.70::DOUBLE",
        "expression": "0.30::DOUBLE + fire / tot * 0.42::DOUBLE + wood / tot * 0.28::DOUBLE",
    }
    clamp = "greatest(0.08::DOUBLE, least(0.92::DOUBLE, {}))"

    def answers(trait):
        parts = [
            f"CASE WHEN {q} = '{a}' THEN {d[trait]}::DOUBLE ELSE 0 END" for (q, a), d in vocab.ANSWER_DELTAS.items() if trait in d
        ]
        parts += [f"({s} - 3) * ({d[trait]}::DOUBLE)" for s, d in vocab.SCALE_DELTAS.items() if trait in d]
        return _sql_sum(parts)

    def events(trait):
        parts = []
        for domain, deltas in vocab.PAST_EVENT_DELTAS.items():
            if trait in deltas:
                step = f"({deltas[trait]}::DOUBLE)"
                if (domain, trait) == ("migration", "exploration"):
                    step += f" * CASE WHEN age_mid <= {vocab.EARLY_AGE} THEN {vocab.EARLY_FACTOR}::DOUBLE ELSE 1 END"
                parts.append(f"CASE WHEN domain = '{domain}' THEN {step} ELSE 0 END")
        return f"sum({_sql_sum(parts)})"

    def shift(x, d):
        return clamp.format(f"1 / (1 + exp(-(ln({x} / (1 - {x})) + {d})))")

    final = ", ".join(
        (f"round({shift(f'a_{t}', f'coalesce(d_{t}, 0)')}, 7) AS {t}" if rounded_out else f"{shift(f'a_{t}', f'coalesce(d_{t}, 0)')} AS {t}")
        for t in vocab.TRAITS
    )
    return f"""
WITH answers AS (SELECT person_id, {shares}, {case(PRESSURE, 4)} AS under_pressure, {case(MODES, 7)} AS project_mode, {case(FEARS, 5)} AS biggest_fear,
  person_id % 5 + 1 AS consistency, person_id % 6 AS mobility FROM persons),
start AS (SELECT *, greatest(wood + fire + earth + metal + water, 1) AS tot FROM answers),
priors AS (SELECT *, {', '.join(f"{clamp.format(start[t])} AS p_{t}" for t in vocab.TRAITS)} FROM start),
answered AS (SELECT person_id, {', '.join(f"{shift(f'p_{t}', '(' + answers(t) + ')')} AS a_{t}" for t in vocab.TRAITS)} FROM priors),
past AS (SELECT person_id, {', '.join(f"{events(t)} AS d_{t}" for t in vocab.TRAITS)} FROM life GROUP BY 1)
SELECT person_id, {final} FROM answered LEFT JOIN past USING (person_id)"""


def branch_shares_sql() -> str:
    raw = {}
    for name, (constant, weights) in vocab.BRANCHES.items():
        raw[name] = f"({constant}::DOUBLE + " + " + ".join(f"{t} * ({w}::DOUBLE)" for t, w in weights.items()) + ")"
    total = " + ".join(raw.values())
    arms = " UNION ALL ".join(f"SELECT person_id, '{n}' AS branch, {v} / ({total}) AS share FROM scores" for n, v in raw.items())
    body = trait_scores_sql(rounded_out=False)
    head, tail = body.rsplit("\nSELECT person_id", 1)
    return (
        f"{head},\nscores AS (SELECT person_id{tail})\n"
        f"SELECT person_id, branch, round(share, 7) AS share, CAST(rank() OVER (PARTITION BY person_id ORDER BY share DESC) AS INTEGER) AS rank FROM ({arms})"
    )
