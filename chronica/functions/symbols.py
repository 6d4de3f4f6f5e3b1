"""Counts over cyclic stem and branch symbols: elements, roles and relations.

A chart has four pillars, so every count is a fixed-size expression of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.functions import vocab

PILLARS = ("year", "month", "day", "hour")
HIDDEN = dict(zip(vocab.BRANCH_SYMBOLS, vocab.BRANCH_HIDDEN_STEMS))


def _element_of(symbols: str, elements: str) -> dict[str, str]:
    return dict(zip(symbols, elements))


STEM_ELEMENT = _element_of(vocab.STEMS, vocab.STEM_ELEMENTS)
BRANCH_ELEMENT = _element_of(vocab.BRANCH_SYMBOLS, vocab.BRANCH_ELEMENTS)


def role_between(day: str, other: str) -> str:
    """Role of a stem seen from the day stem: the step between their elements in
    the generating cycle picks the pair, equal polarity the first of it."""
    step = (vocab.ELEMENTS.index(STEM_ELEMENT[other]) - vocab.ELEMENTS.index(STEM_ELEMENT[day])) % 5
    same = vocab.STEMS.index(day) % 2 == vocab.STEMS.index(other) % 2
    return vocab.TEN_ROLES[2 * step + (0 if same else 1)]


def _packed(slots) -> int:
    """Counts of up to sixteen slots in one whole number, four bits each; a
    chart has at most twelve symbols of a kind, so no slot overflows."""
    return sum(1 << (4 * s) for s in slots)


def _lookup(table: list[int], index: Column) -> Column:
    """Packed counts of a symbol (pair); an absent symbol counts nothing."""
    values = F.expr(f"array({', '.join(f'{v}L' for v in table)})")  # one call, not one per value
    return F.coalesce(F.get(values, index), F.lit(0).cast("bigint"))


def _slot(packed: str, slot: int) -> Column:
    return F.shiftrightunsigned(packed, 4 * slot).bitwiseAND(F.lit(15)).cast("int")


def _place(symbol: Column, symbols: str) -> Column:
    """Place of a symbol in its cycle from 0, null where there is none."""
    listed = F.expr("array(" + ", ".join(f"'{s}'" for s in symbols) + ")")
    return F.nullif(F.array_position(listed, symbol), F.lit(0)).cast("int") - 1


def _relations(symbols: str, relations: dict) -> list[int]:
    """Packed relation counts for every ordered pair of symbols."""
    return [_packed(i for i, pairs in enumerate(relations.values()) if a + b in pairs or b + a in pairs) for a in symbols for b in symbols]


def features(df: DataFrame, keep: list[str]) -> DataFrame:
    """Fixed schema of counts, zeros included. An absent hour counts nothing.

    Symbols become places in their cycles; small tables then give the packed
    counts a symbol (or a pair of symbols) adds, and each feature is one slot.
    """
    places = df.select(
        *keep,
        *[_place(F.col(f"{p}_gan"), vocab.STEMS).alias(f"__g{i}") for i, p in enumerate(PILLARS)],
        *[_place(F.col(f"{p}_zhi"), vocab.BRANCH_SYMBOLS).alias(f"__z{i}") for i, p in enumerate(PILLARS)],
    )
    gans = [F.col(f"__g{i}") for i in range(4)]
    zhis = [F.col(f"__z{i}") for i in range(4)]
    stem_element = [_packed([vocab.ELEMENTS.index(e)]) for e in vocab.STEM_ELEMENTS]
    branch_element = [_packed([vocab.ELEMENTS.index(e)]) for e in vocab.BRANCH_ELEMENTS]
    hidden_stems = [_packed(vocab.STEMS.index(s) for s in h) for h in vocab.BRANCH_HIDDEN_STEMS]

    def roles(day, stems):
        return _packed(vocab.TEN_ROLES.index(role_between(day, s)) for s in stems)

    seen_roles = [roles(d, s) for d in vocab.STEMS for s in vocab.STEMS]
    kept_roles = [roles(d, h) for d in vocab.STEMS for h in vocab.BRANCH_HIDDEN_STEMS]

    def pairs(cols, table, size):
        return sum(
            (_lookup(table, cols[i] * size + cols[j]) for i in range(4) for j in range(i + 1, 4)), F.lit(0).cast("bigint")
        )

    def total(table, cols):
        return sum((_lookup(table, c) for c in cols), F.lit(0).cast("bigint"))

    mask = F.lit(0)
    for z in zhis:
        mask = mask.bitwiseOR(_lookup([1 << n for n in range(12)], z))
    packed = places.select(
        *keep,
        (total(stem_element, gans) + total(branch_element, zhis)).alias("__ve"),
        total(hidden_stems, zhis).alias("__hs"),
        total(seen_roles, [gans[2] * 10 + gans[i] for i in (0, 1, 3)]).alias("__vr"),
        total(kept_roles, [gans[2] * 12 + z for z in zhis]).alias("__hr"),
        pairs(zhis, _relations(vocab.BRANCH_SYMBOLS, vocab.BRANCH_PAIRS), 12).alias("__zr"),
        pairs(gans, _relations(vocab.STEMS, vocab.STEM_PAIRS), 10).alias("__gr"),
        mask.alias("__mask"),
    )
    out: dict[str, Column] = {}
    for i, e in enumerate(vocab.ELEMENTS):
        out[f"visible_element_{e}"] = _slot("__ve", i)
        out[f"hidden_element_{e}"] = _slot("__hs", 2 * i) + _slot("__hs", 2 * i + 1)
    for i, s in enumerate(vocab.STEMS):
        out[f"hidden_gan_{s}"] = _slot("__hs", i)
    for i, name in enumerate(vocab.TEN_ROLES):
        out[f"visible_tengod_{name}"] = _slot("__vr", i)
        out[f"hidden_tengod_{name}"] = _slot("__hr", i)
    for i, name in enumerate(vocab.BRANCH_PAIRS):
        out[name] = _slot("__zr", i)
    for i, name in enumerate(vocab.STEM_PAIRS):
        out[name] = _slot("__gr", i)
    for name, triads in vocab.BRANCH_TRIADS.items():
        bits = [sum(1 << vocab.BRANCH_SYMBOLS.index(s) for s in t) for t in triads]
        out[name] = sum((F.when(F.col("__mask").bitwiseAND(F.lit(b)) == b, 1).otherwise(0) for b in bits), F.lit(0))
    wide = packed.select(*keep, *[c.alias(n) for n, c in out.items()])
    shown = F.array(*[F.col(f"visible_element_{e}") for e in vocab.ELEMENTS])
    kept = F.array(*[F.col(f"hidden_element_{e}") for e in vocab.ELEMENTS])
    return wide.withColumns(
        {
            "visible_element_entropy": F.round(S.entropy(shown), 9),
            "hidden_element_entropy": F.round(S.entropy(kept), 9),
            "visible_element_imbalance": F.array_max(shown) - F.array_min(shown),
        }
    )


def eligibility(df: DataFrame) -> DataFrame:
    """Flags on calendar and boundary doubt, and what they leave eligible."""
    unknown_old = (F.col("calendar_kind") == "unknown") & (F.col("birth_year") < 1900)
    no_time = ~F.col("has_time")
    return df.withColumns(
        {
            "unknown_old": unknown_old,
            "no_time": no_time,
            "eligible": ~unknown_old & ~(F.col("boundary_risk") & no_time),
        }
    )


# --- sample pillars ---------------------------------------------------------
_STEP = {"year": 1, "month": 3, "day": 7, "hour": 11}


def sample_pillars(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")

    def pick(symbols, index):
        return F.element_at(F.array(*[F.lit(s) for s in symbols]), (index % len(symbols) + 1).cast("int"))

    cols = []
    for p in PILLARS:
        gan, zhi = pick(vocab.STEMS, key * _STEP[p]), pick(vocab.BRANCH_SYMBOLS, key * _STEP[p] + F.floor(key / 5))
        if p == "hour":
            gan, zhi = F.when(key % 3 > 0, gan), F.when(key % 3 > 0, zhi)
        cols += [gan.alias(f"{p}_gan"), zhi.alias(f"{p}_zhi")]
    return customer.select(key.alias("person_id"), *cols)


def _list(symbols) -> str:
    return "[" + ", ".join(f"'{s}'" for s in symbols) + "]"


SAMPLE_SQL = "SELECT c_custkey AS person_id, " + ", ".join(
    f"{guard}{_list(vocab.STEMS)}[CAST(c_custkey * {_STEP[p]} % 10 + 1 AS INTEGER)]{end} AS {p}_gan, "
    f"{guard}{_list(vocab.BRANCH_SYMBOLS)}[CAST((c_custkey * {_STEP[p]} + c_custkey // 5) % 12 + 1 AS INTEGER)]{end} AS {p}_zhi"
    for p in PILLARS
    for guard, end in [("CASE WHEN c_custkey % 3 > 0 THEN ", " END") if p == "hour" else ("", "")]
) + " FROM customer"


def features_sql(sample: str) -> str:
    """The same counts by unnesting pillars and joining small value tables."""
    stem_rows = ", ".join(f"('{s}', '{STEM_ELEMENT[s]}')" for s in vocab.STEMS)
    branch_rows = ", ".join(f"('{b}', '{BRANCH_ELEMENT[b]}')" for b in vocab.BRANCH_SYMBOLS)
    hidden_rows = ", ".join(f"('{b}', '{s}')" for b, hs in HIDDEN.items() for s in hs)
    role_rows = ", ".join(f"('{d}', '{s}', '{role_between(d, s)}')" for d in vocab.STEMS for s in vocab.STEMS)
    pair_rows = ", ".join(
        f"('{n}', '{x}')" for n, ps in {**vocab.BRANCH_PAIRS, **vocab.STEM_PAIRS}.items() for x in sorted({p for p in ps} | {p[::-1] for p in ps})
    )
    triad_rows = ", ".join(f"('{n}', '{i}', '{s}')" for n, ts in vocab.BRANCH_TRIADS.items() for i, t in enumerate(ts) for s in t)
    visible = [f"count(*) FILTER (WHERE k = 'v' AND x = '{e}') AS visible_element_{e}" for e in vocab.ELEMENTS]
    hidden = [f"count(*) FILTER (WHERE k = 'h' AND x = '{e}') AS hidden_element_{e}" for e in vocab.ELEMENTS]
    gans = [f"count(*) FILTER (WHERE k = 'g' AND x = '{s}') AS hidden_gan_{s}" for s in vocab.STEMS]
    roles = [f"count(*) FILTER (WHERE k = 'r' AND x = '{r}') AS visible_tengod_{r}, count(*) FILTER (WHERE k = 'q' AND x = '{r}') AS hidden_tengod_{r}" for r in vocab.TEN_ROLES]
    names = [*vocab.BRANCH_PAIRS, *vocab.STEM_PAIRS, *vocab.BRANCH_TRIADS]
    rels = [f"count(*) FILTER (WHERE k = 'rel' AND x = '{n}') AS {n}" for n in names]
    def entropy(prefix):
        cols = [f"{prefix}_{e}" for e in vocab.ELEMENTS]
        total = "(" + " + ".join(cols) + ")"
        return "round(" + " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / {total}::DOUBLE) * ln({c} / {total}::DOUBLE) ELSE 0 END" for c in cols) + ", 9)"
    all_visible = ", ".join(f"visible_element_{e}" for e in vocab.ELEMENTS)
    counts = [c for c in (*visible, *hidden, *gans, *roles, *rels)]
    plain = [c.strip().split(" AS ")[-1] for part in counts for c in part.split(", count")]
    cast = ", ".join(f"CAST({n} AS INTEGER) AS {n}" for n in plain)
    return f"""
WITH charts AS ({sample}),
pillars AS (SELECT person_id, day_gan, unnest([1, 2, 3, 4]) AS i, unnest([year_gan, month_gan, day_gan, hour_gan]) AS g, unnest([year_zhi, month_zhi, day_zhi, hour_zhi]) AS z FROM charts),
stem(s, e) AS (VALUES {stem_rows}), branch(b, e) AS (VALUES {branch_rows}), hid(b, s) AS (VALUES {hidden_rows}),
role(d, s, r) AS (VALUES {role_rows}), pair(n, xy) AS (VALUES {pair_rows}), triad(n, i, s) AS (VALUES {triad_rows}),
facts AS (
  SELECT person_id, 'v' AS k, e AS x FROM pillars JOIN stem ON s = g
  UNION ALL SELECT person_id, 'v', e FROM pillars JOIN branch ON b = z
  UNION ALL SELECT person_id, 'g', s FROM pillars JOIN hid ON b = z
  UNION ALL SELECT person_id, 'h', e FROM pillars JOIN hid ON b = z JOIN stem ON stem.s = hid.s
  UNION ALL SELECT person_id, 'r', r FROM pillars JOIN role ON d = day_gan AND s = g WHERE i <> 3
  UNION ALL SELECT person_id, 'q', r FROM pillars JOIN hid ON b = z JOIN role ON d = day_gan AND role.s = hid.s
  UNION ALL SELECT a.person_id, 'rel', n FROM pillars a JOIN pillars b ON a.person_id = b.person_id AND a.i < b.i JOIN pair ON xy = a.z || b.z OR xy = a.g || b.g
  UNION ALL SELECT person_id, 'rel', n FROM (SELECT person_id, n, triad.i, count(DISTINCT z) AS c FROM pillars JOIN triad ON z = triad.s GROUP BY 1, 2, 3) WHERE c = 3
),
wide AS (SELECT person_id, {', '.join(counts)} FROM facts GROUP BY 1)
SELECT person_id, {cast}, {entropy('visible_element')} AS visible_element_entropy, {entropy('hidden_element')} AS hidden_element_entropy,
  CAST(greatest({all_visible}) - least({all_visible}) AS INTEGER) AS visible_element_imbalance
FROM wide"""
