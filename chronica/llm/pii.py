"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Each value found by pattern and validated (check digit, calendar, ranges) is mapped
by a keyed Feistel network over the numbers its format can hold, so the pseudonym is
as valid as the value: a card number keeps length, separators and a right check
digit, a date stays a date of the same notation, an address keeps its octets in
range. The map is a permutation of the format's values, so equal values stay equal
across documents, different ones stay different, and the key can undo it.

A network takes a pair (a, b) with moduli (M, N) and in turn adds to one half a
keyed hash of the other, for ``ROUNDS`` rounds. All of it is column expressions;
hashes are worked out for matches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.llm import native

ROUNDS = 8
# Characters of one network: halves stay below 10**10 and 26**9.
BLOCK = 18
# Digits of the shortest card number.
LEAST_CARD = 13
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
# 400 Gregorian years from 1800 have 146097 = 189 * 773 days.
EPOCH, DAY_SPLIT = "1800-01-01", (189, 773)

KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,6}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|[.-][0-9])",
}
ANY = "|".join(KINDS.values())


def _noise(key: Column, tweak: Column, round_: Column, value: Column, modulus: Column) -> Column:
    """Keyed hash of a half, below ``modulus``."""
    digest = F.sha2(F.concat_ws("|", key, tweak, round_, value), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % modulus


def feistel(a: Column, b: Column, m: Column, n: Column, key: Column, tweak: Column, undo: bool = False) -> Column:
    """Permute pairs with 0 <= a < m and 0 <= b < n; a struct (a, b)."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    pair = lambda x, y: F.struct(x.cast("bigint").alias("a"), y.cast("bigint").alias("b"))
    add = lambda x, h, mod: (x - h + mod) % mod if undo else (x + h) % mod

    def step(s: Column, r: Column) -> Column:
        left = pair(add(s["a"], _noise(key, tweak, r, s["b"], m), m), s["b"])
        right = pair(s["a"], add(s["b"], _noise(key, tweak, r, s["a"], n), n))
        return F.when(r % 2 == 0, left).otherwise(right)

    return F.aggregate(rounds, pair(a, b), step)


def _powers(base: int) -> Column:
    return F.array(*[F.lit(base**k).cast("bigint") for k in range(BLOCK // 2 + 1)])


def _block(text: Column, alphabet: str, key: Column, tweak: Column, undo: bool) -> Column:
    """Permute the strings of one length of at most BLOCK characters of an alphabet."""
    base, letters = len(alphabet), F.lit(alphabet)
    number = lambda t: F.aggregate(
        F.filter(F.split(t, ""), lambda c: c != ""),
        F.lit(0).cast("bigint"),
        lambda acc, c: acc * base + (F.instr(letters, c) - 1),
    )
    power = _powers(base)

    def written(x: Column, length: Column) -> Column:
        divided = lambda k: F.call_function("div", x, F.get(power, k)) % base
        one = lambda k: F.substring(letters, (divided(k) + 1).cast("int"), F.lit(1))
        every = F.transform(F.sequence(length - 1, F.lit(0), F.lit(-1)), one)
        return F.when(length > 0, F.array_join(every, "")).otherwise("")

    size = F.length(text)
    la = F.floor(size / 2).cast("int")
    lb = size - la
    a, b = F.substring(text, F.lit(1), la), F.substring(text, la + 1, lb)
    out = feistel(number(a), number(b), F.get(power, la), F.get(power, lb), key, F.concat_ws(":", tweak, size), undo)
    return native.bind(out, lambda s: F.concat(written(s["a"], la), written(s["b"], lb)))


def _permuted(text: Column, alphabet: str, key: Column, tweak: Column, undo: bool) -> Column:
    """Permute a string of any length block by block; each block by its place."""
    count = F.floor((F.length(text) + BLOCK - 1) / BLOCK).cast("int")
    one = lambda k: _block(F.substring(text, k * BLOCK + 1, F.lit(BLOCK)), alphabet, key, F.concat_ws(":", tweak, k), undo)
    every = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one)
    return F.when(F.length(text) > 0, F.array_join(every, "")).otherwise("")


def _refilled(shape: Column, fresh: Column, wanted: str) -> Column:
    """``shape`` with its characters of class ``wanted`` replaced in turn by ``fresh``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    nth = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{wanted}]", ""))
    put = lambda c, i: F.when(c.rlike(f"[{wanted}]"), F.substring(fresh, nth(i), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(chars, put), "")


def _only(text: Column, wanted: str) -> Column:
    return F.regexp_replace(text, f"[^{wanted}]", "")


def luhn_digit(body: Column) -> Column:
    """Check digit that makes ``body`` and it a valid card number."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(body, F.length(body) - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def _card(t: Column, key: Column, undo: bool) -> Column:
    """The longest reading that is valid: the whole match, or what ends before one of its separators."""
    digits = _only(t, "0-9")
    first = lambda text, n: F.substring(text, F.lit(1), n)
    valid = lambda text, n: luhn_digit(first(text, n - 1)) == F.substring(text, n, F.lit(1))
    ends = F.filter(
        F.sequence(F.length(t), F.lit(LEAST_CARD), F.lit(-1)),
        lambda p: (p == F.length(t)) | F.substring(t, p + 1, F.lit(1)).isin(" ", "-"),
    )
    sizes = F.filter(F.transform(ends, lambda p: F.length(_only(first(t, p), "0-9"))), lambda n: n >= LEAST_CARD)

    def replaced(sizes: Column, size: Column) -> Column:
        longer, rest = F.filter(sizes, lambda n: n > size), F.substring(digits, size + 1, F.length(digits))
        whole = lambda body: F.concat(body, luhn_digit(body), rest)
        state = lambda body, go: F.struct(body.alias("body"), go.alias("go"))

        def step(s: Column, _: Column) -> Column:
            # The network goes on until no longer reading is valid, so that the pseudonym is read alike.
            wrong = lambda body: native.bind(whole(body), lambda w: F.exists(longer, lambda n: valid(w, n)))
            fresh = _permuted(s["body"], DIGITS, key, F.lit("card"), undo)
            return F.when(s["go"], native.bind(fresh, lambda body: state(body, wrong(body)))).otherwise(s)

        walked = F.aggregate(F.sequence(F.lit(1), F.lit(200)), state(first(digits, size - 1), F.lit(True)), step)
        return F.when(size.isNotNull(), native.bind(walked, lambda s: _refilled(t, whole(s["body"]), "0-9")))

    longest = lambda sizes: F.get(F.filter(sizes, lambda n: valid(digits, n)), F.lit(0))
    return native.bind(sizes, lambda s: native.bind(longest(s), lambda n: replaced(s, n)))


def _phone(t: Column, key: Column, undo: bool) -> Column:
    """The country code stays; the national number is permuted."""
    prefix = F.regexp_extract(t, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    code = F.when(prefix == "", F.regexp_extract(t, r"^\+[0-9]", 0)).otherwise(prefix)
    rest = F.substring(t, F.length(code) + 1, F.length(t))
    digits = _only(rest, "0-9")
    many = F.length(_only(t, "0-9"))
    fresh = _permuted(digits, DIGITS, key, F.concat_ws(":", F.lit("phone"), code), undo)
    return F.when(many.between(7, 15), F.concat(code, _refilled(rest, fresh, "0-9")))


def _ip(t: Column, key: Column, undo: bool) -> Column:
    octets = F.transform(F.split(t, r"\."), lambda x: x.cast("int"))
    at = lambda o, k: F.get(o, F.lit(k))
    valid = F.forall(octets, lambda o: o <= 255) & ~t.rlike(r"(^|\.)0[0-9]")
    m = F.lit(65536).cast("bigint")

    def run(o: Column) -> Column:
        out = feistel(at(o, 0) * 256 + at(o, 1), at(o, 2) * 256 + at(o, 3), m, m, key, F.lit("ip"), undo)
        split = lambda x: [F.shiftright(x, 8), x.bitwiseAND(F.lit(255).cast("bigint"))]
        return native.bind(out, lambda s: F.concat_ws(".", *split(s["a"]), *split(s["b"])))

    return F.when(valid, native.bind(octets, run))


def _ssn(t: Column, key: Column, undo: bool) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(t, p, n).cast("bigint") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    m, n = F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint")
    out = feistel(rank * 99 + group - 1, serial - 1, m, n, key, F.lit("ssn"), undo)

    def written(s: Column) -> Column:
        r = F.call_function("div", s["a"], F.lit(99).cast("bigint"))
        fresh = F.when(r >= 665, r + 2).otherwise(r + 1)
        pad = lambda x, w: F.lpad(x.cast("string"), w, "0")
        return F.concat_ws("-", pad(fresh, 3), pad(s["a"] % 99 + 1, 2), pad(s["b"] + 1, 4))

    return F.when(valid, native.bind(out, written))


def _date(t: Column, key: Column, undo: bool) -> Column:
    """Years 1800 to 2199. With slashes day first is read, and month first where that is no date."""
    iso, slash = F.contains(t, F.lit("-")), F.contains(t, F.lit("/"))
    field = lambda p, n: F.substring(t, p, n)
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    first = day(field(7, 4), field(4, 2), field(1, 2))
    swapped = day(field(7, 4), field(1, 2), field(4, 2))
    month_first = slash & first.isNull()
    date = F.when(iso, day(field(1, 4), field(6, 2), field(9, 2))).when(month_first, swapped).otherwise(first)
    index = F.datediff(date, F.lit(EPOCH).cast("date")).cast("bigint")
    m, n = (F.lit(x).cast("bigint") for x in DAY_SPLIT)
    width = DAY_SPLIT[1]
    back = lambda i: F.date_add(F.lit(EPOCH).cast("date"), i.cast("int"))

    def permute(i: Column) -> Column:
        halves = feistel(F.call_function("div", i, n), i % width, m, n, key, F.lit("date"), undo)
        return native.bind(halves, lambda s: s["a"] * width + s["b"])

    def walk(i: Column) -> Column:
        # Month-first dates go on until the day is beyond 12 again, so that the
        # pseudonym, too, can only be read month first.
        again = lambda x, _: F.when(F.dayofmonth(back(x)) > 12, x).otherwise(permute(x))
        return F.aggregate(F.sequence(F.lit(1), F.lit(200)), permute(i), again)

    shape = F.when(iso, "yyyy-MM-dd").when(month_first, "MM/dd/yyyy").when(slash, "dd/MM/yyyy").otherwise("dd.MM.yyyy")
    fresh = F.when(month_first, walk(index)).otherwise(permute(index))
    return F.when(index.between(0, DAY_SPLIT[0] * width - 1), native.bind(fresh, lambda i: F.call_function("date_format", back(i), shape)))


def _email(t: Column, key: Column, undo: bool) -> Column:
    """The local part is permuted, letters as letters in their case and digits as digits."""
    local = F.substring_index(t, "@", 1)
    letters, digits = F.lower(_only(local, "A-Za-z")), _only(local, "0-9")
    # What stays is part of the tweak: lengths, marks and domain.
    frame = F.concat(F.lit("email:"), F.regexp_replace(F.regexp_replace(t, "[A-Za-z](?=.*@)", "a"), "[0-9](?=.*@)", "0"))
    fresh = _permuted(letters, LETTERS, key, frame, undo)
    filled = _refilled(_refilled(local, fresh, "A-Za-z"), _permuted(digits, DIGITS, key, frame, undo), "0-9")
    capital = F.transform(
        F.arrays_zip(F.filter(F.split(local, ""), lambda c: c != "").alias("o"), F.filter(F.split(filled, ""), lambda c: c != "").alias("f")),
        lambda p: F.when(p["o"].rlike("[A-Z]"), F.upper(p["f"])).otherwise(p["f"]),
    )
    return F.concat(F.array_join(capital, ""), F.substring(t, F.length(local) + 1, F.length(t)))


MAPS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _whole(kind: str) -> str:
    return f"^(?:{KINDS[kind]})$"


def _replaced(match: Column, key: Column, undo: bool) -> Column:
    """Struct (kind, text) of a match; kind is null and text as it was where it is not valid."""

    def settle(found: Column) -> Column:
        return F.struct(F.when(found["t"].isNotNull(), found["k"]).alias("kind"), F.coalesce(found["t"], match).alias("text"))

    kind = F.lit(None).cast("string")
    fresh = F.lit(None).cast("string")
    for name in reversed(KINDS):
        here = match.rlike(_whole(name))
        kind = F.when(here, F.lit(name)).otherwise(kind)
        fresh = F.when(here, MAPS[name](match, key, undo)).otherwise(fresh)
    return native.bind(F.struct(kind.alias("k"), fresh.alias("t")), settle)


def pseudonymise(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms and the number of values replaced by kind.

    Works on whole texts; a null text is empty, values that fail their validation
    stay, repeated rows stay and agree. ``undo`` with the same key restores the
    texts. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = text.rlike("[0-9@]") & text.rlike(ANY)
    none = F.array().cast("array<struct<kind:string,text:string>>")
    fresh = F.transform(native.matched(text, ANY), lambda m: _replaced(m, F.lit(key), undo))
    found = docs.select(
        "doc_id",
        text.alias("text"),
        F.when(hit, native.between(text, ANY)).otherwise(F.array(text)).alias("gaps"),
        F.when(hit, fresh).otherwise(none).alias("fresh"),
    )
    tails = F.array_append(F.transform("fresh", lambda f: f["text"]), F.lit(""))
    joined = F.array_join(F.zip_with("gaps", tails, lambda g, t: F.concat(g, t)), "")
    count = lambda k: F.size(F.filter("fresh", lambda f: f["kind"].eqNullSafe(F.lit(k)))).cast("bigint")
    return found.select("doc_id", joined.alias("text"), *[count(k).alias(f"n_{k}") for k in KINDS])
