"""Phrase collocation mining by SETM: relations of occurrences, merge-joined, counted, semi-joined.

Occurrences are kept sorted by place. A chunk of documents of one language is the unit that tasks
hold: its occurrences are columns of numbers in one row of a written table, places ascending, with
marks between pieces. Each round

1. merge-joins the occurrences of frequent phrases of k-1 words with those of frequent words at the
   adjacent place of the same piece, inside every chunk,
2. counts the groups (phrase, word): first within the chunk, then over all chunks in one shuffle of
   three numbers and a count,
3. semi-joins: the groups that are frequent go back to the chunks that hold them, and only their
   occurrences are kept, sorted, for the next length.

Words and phrases carry whole numbers given to the frequent groups of a language, so that nothing
rests on hashes. Nothing is broadcast by hand and no task holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronica import session
from chronica.llm import textbytes

# Words of one chunk; a document is never cut, so one of more words is a chunk of its own.
CHUNK_WORDS = 1 << 21
LEAST = 30
LONGEST = 4
SHARE = 80
FIRST = 2000
# Ends of pieces; a run of anything else without spaces and tabs is a word.
PIECE_END = r"[.,;:!?\n\v\f\r]"
# Stands for an end of a piece among the words: it ends pieces itself, so it is no word.
MARK = "."
SCALE = 2000000

TOKENS = "chunk bigint, lang string, words binary, vocabulary array<string>, counts array<bigint>"
# A row of a chunk's occurrences, and rows of its groups: the columns of the other kind are null.
ROUND = "chunk bigint, steps binary, phrases binary, ids binary, words binary, word_ids binary, first bigint, second bigint, n bigint"
PLACES = ["chunk", "steps", "phrases", "ids", "words", "word_ids"]
GROUPS = ["chunk", "first", "second", "n"]
# Group rows that leave a task at a time.
BATCH = 1 << 16


def _packed(values: np.ndarray, dtype) -> bytes:
    """Numbers as compressed bytes, led by their size."""
    body = pa.py_buffer(np.ascontiguousarray(values, dtype=dtype))
    return body.size.to_bytes(8, "little") + (pa.compress(body, codec="zstd", asbytes=True) if body.size else b"")


def _unpacked(body: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(body[:8], "little")
    raw = pa.decompress(memoryview(body)[8:], decompressed_size=size, codec="zstd") if size else b""
    return np.frombuffer(raw, dtype=dtype)


def _words(texts: pa.Array) -> pa.DictionaryArray:
    """Words of the texts in order, a MARK after each piece and each text, as numbers into their list."""
    texts = pc.ascii_lower(texts.cast(pa.large_string()))
    marked = pc.replace_substring_regex(texts, pattern=PIECE_END, replacement=f" {MARK} ")
    closed = pc.binary_join_element_wise(marked, pa.scalar(f" {MARK}", marked.type), pa.scalar("", marked.type))
    flat = pc.ascii_split_whitespace(closed).flatten()
    return flat.filter(pc.not_equal(flat, "")).dictionary_encode()


def _chunk(number: int, lang: str, words: list[pa.DictionaryArray]) -> pa.RecordBatch:
    """One row: words as numbers from 0 in order, -1 for marks, with their texts and counts."""
    coded = pa.concat_arrays(words)
    names, places = coded.dictionary, coded.indices.to_numpy()
    mark = pc.index(names, pa.scalar(MARK, names.type)).as_py()
    counts = np.delete(np.bincount(places, minlength=len(names)), mark)
    names = names.filter(pc.not_equal(names, MARK)).cast(pa.string())
    places = np.where(places == mark, -1, places - (places > mark))
    columns = {
        "chunk": pa.array([number], pa.int64()),
        "lang": pa.array([lang], pa.string()),
        "words": pa.array([_packed(places, np.int32)], pa.binary()),
        "vocabulary": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
        "counts": pa.array([counts], pa.list_(pa.int64())),
    }
    return pa.RecordBatch.from_pydict(columns)


def _tokens(chunk_words: int):
    """Task that makes chunks of one language each, numbered by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[pa.DictionaryArray]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for part in textbytes.slices(batch):
                langs = part.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    words = _words(part.column("text").filter(pc.equal(langs, lang)))
                    held.setdefault(lang, []).append(words)
                    sizes[lang] = sizes.get(lang, 0) + len(words)
                    if sizes[lang] >= chunk_words:
                        number += 1
                        yield _chunk(number, lang, held.pop(lang))
                        del sizes[lang]
        for lang, words in held.items():
            number += 1
            yield _chunk(number, lang, words)

    return run


def _merged(places: np.ndarray, phrases: np.ndarray, words: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of phrases of ``length`` - 1 words with the word after them in their piece.

    Both sides are sorted by place. From its second word on a longer phrase must be frequent too:
    that is an entry at the next place. Gives places and codes phrase * ``width`` + word."""
    after = places + (length - 1)
    ok = after < len(words)
    ok[ok] = words[after[ok]] >= 0
    if length > 2:
        ok[:-1] &= places[1:] == places[:-1] + 1
        ok[-1:] = False
    codes = phrases[ok].astype(np.int64)
    codes *= width
    codes += words[after[ok]]
    return places[ok], codes


def _at(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted ids, all of which are there."""
    order = np.argsort(ids, kind="stable")
    return order[np.searchsorted(ids[order], wanted)]


def _semi_join(places: np.ndarray, codes: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences whose code is among ``kept`` (ascending), as numbers of its entries."""
    if not len(kept):
        return places[:0], places[:0]
    at = np.searchsorted(kept, codes)
    np.minimum(at, len(kept) - 1, out=at)
    ok = kept[at] == codes
    return places[ok], at[ok].astype(np.int32)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with their counts; the codes are sorted in place."""
    codes.sort()
    new = np.ones(len(codes), dtype=bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return codes[at], np.diff(at, append=len(codes))


def _round(length: int, last: bool):
    """Task of one round for one chunk: semi-join by the last round's frequent groups, then merge join
    and count. ``left`` is the chunk as the last round left it, ``right`` its frequent groups. After
    the ``last`` round only the counts are of use."""
    schema = pa.schema([(c, pa.binary() if c in PLACES[1:] else pa.int64()) for c in [*PLACES, *GROUPS[1:]]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        ids = right.column("id").to_numpy()
        words = _unpacked(row["words"], np.int32)
        if length == 2:
            renumbered = np.full(int(words.max(initial=-1)) + 2, -1, dtype=np.int32)
            renumbered[right.column("number").to_numpy()] = np.arange(len(ids))
            words = renumbered[words]  # marks read the last entry, which no word has
            word_ids = ids
        else:
            word_ids = _unpacked(row["word_ids"], np.int64)
        places = np.flatnonzero(words >= 0).astype(np.int32)
        phrases = words[places]
        width = max(len(word_ids), 1)
        if length > 2:
            phrase_ids = word_ids
            if length > 3:
                places = np.cumsum(_unpacked(row["steps"], np.int32), dtype=np.int32)
                phrases = _unpacked(row["phrases"], np.int32)
                phrase_ids = _unpacked(row["ids"], np.int64)
            kept = _at(phrase_ids, right.column("first").to_numpy()) * width + _at(word_ids, right.column("second").to_numpy())
            order = np.argsort(kept)
            places, phrases = _semi_join(*_merged(places, phrases, words, width, length - 1), kept[order])
            ids = ids[order]
        out = []
        if not last:
            store = [(np.diff(places, prepend=np.int32(0)), np.int32), (phrases, np.int32), (ids, np.int64)] if length > 2 else [(places[:0], np.int32)] * 3
            store += [(words, np.int32), (word_ids, np.int64)]
            values = [row["chunk"], *[_packed(*column) for column in store], *[None] * len(GROUPS[1:])]
            out.append(pa.RecordBatch.from_arrays([pa.array([v], c.type) for v, c in zip(values, schema)], schema=schema))
            del store, values
        codes = _merged(places, phrases, words, width, length)[1]
        del places, phrases, words
        found, counts = _distinct(codes)
        # What all groups have alike is there once.
        alike = [pa.array(np.full(min(BATCH, len(found)), row["chunk"])), *[pa.nulls(min(BATCH, len(found)), pa.binary())] * len(PLACES[1:])]
        for a in range(0, len(found), BATCH):
            part = found[a : a + BATCH]
            own = [ids[part // width], word_ids[part % width], counts[a : a + BATCH]]
            out.append(pa.RecordBatch.from_arrays([*[c[: len(part)] for c in alike], *map(pa.array, own)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def _counted(groups: DataFrame, names: list[str], least: int, label: str) -> DataFrame:
    """Frequent groups over all chunks, in one shuffle: a row per group and chunk that holds it, with the
    group's count over all chunks as ``total``, a whole number of its own as ``id``, and ``one`` at one of its
    rows. A group has at most a row per chunk here, and windows spill."""
    group = Window.partitionBy(*names)
    rows = groups.withColumn("total", F.sum("n").over(group)).where(F.col("total") >= least).drop("n")
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    rows = rows.withColumn("id", F.min("__row").over(group))
    return session.materialised(rows.withColumn("one", F.col("__row") == F.col("id")).drop("__row"), label)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language, and the frequent phrases of 1 to ``longest`` words as written tables.

    A phrase has lang, phrase, n, id, ``before`` (counts of its first 1, 2, ... words) and ``after`` (counts
    of what follows those). Every part of a frequent phrase is frequent, so the counts come with
    the joins that build its text."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = session.materialised(rows.mapInArrow(_tokens(chunk_words), TOKENS), "tokens")
    sizes = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    totals = session.materialised(chunks.groupBy("lang").agg(F.sum(sizes).alias("total")), "totals")
    groups = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("vocabulary", "counts")).alias("number", "g"))
    groups = groups.select("chunk", "lang", "number", F.col("g.vocabulary").alias("phrase"), F.col("g.counts").alias("n"))
    found = _counted(groups, ["lang", "phrase"], least, "counted1")
    nothing = F.array().cast("array<bigint>")
    words = found.where("one").select("lang", "phrase", F.lit("").alias("rest"), F.col("total").alias("n"), "id", nothing.alias("before"), nothing.alias("after"))
    words = session.materialised(words, "phrases1")
    levels, marks = [words], ["number"]
    occurrences = chunks.select("chunk", "words")
    for length in range(2, longest + 1):
        # The frequent groups go back to the chunks that hold them.
        back = found.select(F.col("chunk").alias("at"), *marks, "id")
        joined = occurrences.groupBy("chunk").cogroup(back.groupBy("at"))
        done = session.materialised(joined.applyInArrow(_round(length, length == longest), ROUND), f"round{length}")
        session.discard(chunks, found)
        chunks, occurrences = done, done.select(*PLACES).where("words IS NOT NULL")
        names = marks = ["first", "second"]
        found = _counted(done.select(*GROUPS).where("first IS NOT NULL"), names, least, f"counted{length}")
        groups = found.where("one").select(*names, F.col("total").alias("n"), "id")
        levels.append(session.materialised(_described(groups, levels[-1], words, length), f"phrases{length}"))
    session.discard(chunks, found)
    return totals, levels


def _described(counted: DataFrame, shorter: DataFrame, words: DataFrame, length: int) -> DataFrame:
    """Texts and part counts of counted groups (first, second) from those of one word less."""
    head = shorter.select(
        F.col("id").alias("first"), "lang", F.col("phrase").alias("head"), F.col("rest").alias("head_rest"), F.col("n").alias("head_n"), F.col("before").alias("head_before")
    )
    last = words.select(F.col("id").alias("second"), F.col("phrase").alias("word"))
    rows = counted.join(head, "first").join(last, "second")
    rest = F.col("word") if length == 2 else F.concat_ws(" ", "head_rest", "word")
    rows = rows.select(
        "lang",
        F.concat_ws(" ", "head", "word").alias("phrase"),
        rest.alias("rest"),
        "n",
        "id",
        F.array_append("head_before", F.col("head_n")).alias("before"),
    )
    tail = shorter.select("lang", F.col("phrase").alias("rest"), F.array_prepend("after", F.col("n")).alias("after"))
    return rows.join(tail, ["lang", "rest"])


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, first: int = FIRST, chunk_words: int = CHUNK_WORDS
) -> DataFrame:
    """The best ``first`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are split at ends of sentences and lines into pieces, pieces at spaces and tabs into words;
    only A-Z are lower-cased. Phrases of 2 to ``longest`` words with ``a`` >= ``least`` occurrences are
    candidates; a cut into two parts with counts l and r scores floor(2000000 * a / (l + r)), and the
    lowest counts, ties to the earliest cut. Candidates that lie inside a longer one with at least
    ``share`` percent of their count go. Order: score, then a, descending, then the phrase's bytes.

    Null texts are empty, null languages are ``und``; repeated rows count each time, texts are read
    whole, an empty table or one without frequent phrases gives no rows; other columns are not read.
    ``chunk_words`` only sizes the unit of work.
    """
    totals, levels = frequent(docs, least, longest, chunk_words)
    every = None
    for length, level in enumerate(levels[1:], 2):
        rows = level.select("lang", "phrase", F.col("n").alias("a"), "before", "after", F.lit(length).alias("length"))
        every = rows if every is None else every.union(rows)
    cuts = F.expr(
        "transform(sequence(0, length - 2), k -> named_struct("
        f"'score', CAST(a AS DECIMAL(20, 0)) * {SCALE} div (CAST(before[k] AS DECIMAL(20, 0)) + CAST(after[k] AS DECIMAL(20, 0))), "
        "'k', k, 'l', before[k], 'r', after[k]))"
    )
    scored = every.select("lang", "phrase", "a", F.array_min(cuts).alias("cut"))
    inner = F.expr(
        "flatten(transform(sequence(2, length - 1), m -> transform(sequence(0, length - m), s -> array_join(slice(split(phrase, ' '), s + 1, m), ' '))))"
    )
    longer = every.where("length > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("outer_n"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("outer_n").alias("outer_n"))
    inside = F.coalesce(F.col("outer_n").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share, F.lit(False))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~inside)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), F.col("cut.score").cast("bigint").alias("score")
    )
