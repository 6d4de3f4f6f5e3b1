"""Near duplicates by ProbMinHash over shingles, banding and exact verification.

A document is its set of five-word shingles. Each shingle emits a Poisson process of
points at a rate of its weight; a point is a time and a register, drawn from the
shingle's own hash, so all documents see the same process at their own pace. A register
keeps the shingle that reaches it first. Two documents agree in a register with the
probability Jaccard similarity of their weights. Every distinct shingle weighs one here,
however often it is repeated, so that this is the Jaccard similarity of the sets, which
verification asks for. A shingle stops as soon as its next point is later than the latest
register, so long documents cost little more than one point per shingle.

Exact copies (equal sequences of words) fold into one representative first. Bands of
registers give buckets. In each bucket the most connected member is the hub, and
every other member is verified against it on exact shingle sets; that links a group of any
size by as many pairs as it has members. Where a bucket then still falls into several
components, the members outside its largest one meet all others in blocks of bounded
size, which give only the links that join components. Components of verified links
are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronica import session
from chronica.llm import components, textbytes

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
# Share of equal registers below which a pair cannot be expected to reach the
# threshold: four standard deviations of the estimate.
MARGIN = 4 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
BLOCK_MEMBERS = 512

SKETCH = "doc_id bigint, d1 bigint, d2 bigint, n bigint, signature binary"


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per row, sorted by row, with their counts."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


def signatures(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures (rows, registers) of 32-bit shingle names; 0 in rows without shingles."""
    # Time in the high half and the name in the low one, so the smaller number is the earlier point.
    best = np.full(rows * registers, np.iinfo(np.uint64).max, dtype=np.uint64)
    name = (hashes >> np.uint64(32)) | np.uint64(1)
    live, time, state = np.arange(len(hashes)), np.zeros(len(hashes)), hashes.copy()
    while len(live):
        state = textbytes.mix(state + textbytes.BASE)
        chance = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
        time = time - np.log1p(-chance) / weight[live]
        register = (textbytes.mix(state ^ textbytes.MIX_B) % np.uint64(registers)).astype(np.int64)
        stamp = time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
        np.minimum.at(best, owner[live] * registers + register, stamp | name[live])
        latest = (best.reshape(rows, registers).max(axis=1) >> np.uint64(32)).astype(np.uint32)
        bound = latest.view(np.float32).astype(np.float64)
        bound[np.isnan(bound)] = np.inf  # a register is still empty
        go = time <= bound[owner[live]]
        live, time, state = live[go], time[go], state[go]
    out = (best & np.uint64(0xFFFFFFFF)).astype("<u4").reshape(rows, registers)
    out[best.reshape(rows, registers) == np.iinfo(np.uint64).max] = 0
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the words (two longs), distinct shingles and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch):
                words, first = textbytes.word_hashes(part.column("text"))
                h, o, _ = weighted(*textbytes.shingles(words, first, WIDTH))
                sign = signatures(h, o, np.ones(len(h)), part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(textbytes.row_hashes(words, first, 1).view(np.int64)),
                        pa.array(textbytes.row_hashes(words, first, 2).view(np.int64)),
                        pa.array(np.bincount(o, minlength=part.num_rows)),
                        pa.array([s.tobytes() for s in sign], pa.binary()),
                    ],
                    names=["doc_id", "d1", "d2", "n", "signature"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the pairs (a, b) whose sets of shingles have a Jaccard similarity of ``threshold``."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    left = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch, "text_a"):
                keys = []
                for side in ("text_a", "text_b"):
                    hashes, owner = textbytes.shingles(*textbytes.word_hashes(part.column(side)), WIDTH)
                    # One number for a shingle in a row, so that sets of all rows are one set.
                    keys.append(np.unique(textbytes.mix(hashes ^ textbytes.mix(owner.astype(np.uint64) + textbytes.BASE))))
                    size = np.bincount(weighted(hashes, owner)[1], minlength=part.num_rows)
                    if side == "text_a":
                        size_a, owner_a, hashes_a = size, owner, hashes
                common = np.intersect1d(*keys, assume_unique=True)
                mine = textbytes.mix(hashes_a ^ textbytes.mix(owner_a.astype(np.uint64) + textbytes.BASE))
                mine, at = np.unique(mine, return_index=True)
                inside = owner_a[at[np.isin(mine, common, assume_unique=True)]]
                shared = np.bincount(inside, minlength=part.num_rows)
                union = size_a + size - shared
                close = shared >= threshold * union - 1e-9
                close &= union > 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).filter(pa.array(close)) for c in ("a", "b")], names=["a", "b"]
                )

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint").distinct()


def copies(sketches: DataFrame) -> DataFrame:
    """d1, d2 and rep: the smallest id of each class of equal word sequences."""
    return sketches.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))


def buckets(reps: DataFrame) -> DataFrame:
    """key, band, rep, size: memberships in buckets that at least two representatives share."""
    width = 4 * ROWS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring(F.col("signature"), b * width + 1, F.lit(width))).alias("key")),
    )
    each = reps.where("n > 0").select("rep", F.inline(bands))
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return each.join(sizes, "key")


def stars(members: DataFrame) -> DataFrame:
    """Pairs of each member and the hub of its bucket: the one with most bucket mates."""
    weight = members.groupBy("rep").agg(F.sum("size").alias("mates"))
    ranked = members.join(weight, "rep").select("key", "rep", F.struct("mates", (-F.col("rep")).alias("last")).alias("order"))
    hubs = ranked.groupBy("key").agg((-F.max("order")["last"]).alias("hub"))
    pairs = members.join(hubs, "key").where("rep != hub")
    return pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def shingle_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """rep and its sorted distinct shingle hashes, eight bytes each, for the given reps."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(ids, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch):
                h, o, _ = weighted(*textbytes.shingles(*textbytes.word_hashes(part.column("text")), WIDTH))
                cut = np.searchsorted(o, np.arange(part.num_rows + 1))
                body = pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("rep"), body], names=["rep", "shingles"])

    return texts.mapInArrow(run, "rep bigint, shingles binary").dropDuplicates(["rep"])


def crossings(members: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, block: int = BLOCK_MEMBERS) -> DataFrame:
    """Links (a, b) between components that share a bucket: enough to join all that are linked.

    In a bucket of three or more, all members outside its largest component (its minors)
    meet every member; in one of two the hub has settled it. Both sides are dealt into
    blocks of about ``block``, and a block pair is one group, so no group grows with
    the bucket. A group looks at pairs of different components whose signatures can
    reach the threshold, the likeliest first, and verifies them on their whole
    shingle sets; once two components are joined, their other pairs are not needed. A pair
    that shares several buckets is looked at in the first band of them.
    """
    own = members.where("size > 2").join(labels, members["rep"] == labels["node"], "left").select(
        "key", "band", "rep", F.coalesce("label", "rep").alias("label")
    )
    parts = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")
    )
    main = main.where("parts > 1").select("key", F.col("top.label").alias("main"), "size", (F.col("size") - F.col("top.n")).alias("minors"))
    cut = lambda n: F.ceil(F.col(n) / block).cast("int")
    open_members = own.join(main, "key").withColumns({"of_members": cut("size"), "of_minors": cut("minors")})
    open_members = session.materialised(open_members, "open-buckets")
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = open_members.select(
        "key", "band", "rep", "label", F.lit(0).alias("minor"), dealt("of_members").alias("i"), F.explode(F.sequence(F.lit(0), F.col("of_minors") - 1)).alias("j")
    )
    minors = open_members.where("label != main").select(
        "key", "band", "rep", "label", F.lit(1).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("of_members") - 1)).alias("i"), dealt("of_minors").alias("j")
    )
    ids = open_members.select("rep").distinct()
    sets = shingle_sets(ids, docs).join(reps.select("rep", "signature"), "rep")
    grid = every.unionByName(minors).join(sets, "rep")
    group = ["key", "i", "j"]
    return grid.repartition(*group).sortWithinPartitions(*group).mapInArrow(_meet, "a bigint, b bigint").distinct()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of groups that lie in a row, where a group may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    names = ["key", "i", "j"]
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            part = batch.slice(a, b - a)
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in names):
                yield _links(held)
                held = []
            held.append(part)
    if held:
        yield _links(held)


def _links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts)
    minor = rows.column("minor").to_numpy() == 1
    found: list[tuple[int, int]] = []
    if minor.any():
        rep, label = rows.column("rep").to_numpy(), rows.column("label").to_numpy()
        band = rows.column("band")[0].as_py()
        sign = np.stack([np.frombuffer(s.as_buffer(), dtype="<u4") for s in rows.column("signature")])
        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in rows.column("shingles")]
        root = {x: x for x in label.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        others = np.flatnonzero(~minor)
        for i in np.flatnonzero(minor):
            equal = sign[others] == sign[i]
            share = equal.mean(axis=1)
            first = equal.reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            near = np.flatnonzero((label[others] != label[i]) & (share >= THRESHOLD - MARGIN) & first)
            for k in others[near[np.argsort(-share[near], kind="stable")]]:
                mine, its = find(int(label[i])), find(int(label[k]))
                if mine == its:
                    continue
                # Sets too different in size cannot reach the threshold.
                small, large = sorted((len(sets[i]), len(sets[k])))
                if small < THRESHOLD * large - 1e-9:
                    continue
                shared = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if shared >= THRESHOLD * (small + large - shared) - 1e-9:
                    root[mine] = its
                    found.append((min(rep[i], rep[k]), max(rep[i], rep[k])))
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the smallest id of its class, for every row.

    Texts without words are copies of each other. Rows that share an id share a
    class. A row without id belongs to the class of its exact copies that have one; if
    none has, its class is null and nothing is linked to it. Repeated rows stay;
    an empty table gives no rows.
    """
    sketches = session.materialised(sketched(docs), "sketches")
    folded = session.materialised(copies(sketches), "copies")
    reps = sketches.join(folded, ["d1", "d2"]).where("doc_id = rep").dropDuplicates(["rep", "d1", "d2"])
    reps = session.materialised(reps.select("rep", "n", "signature"), "reps")
    members = session.materialised(buckets(reps), "members")
    links = session.materialised(verified(stars(members), docs), "stars")
    labels = components.label(links)
    more = session.materialised(crossings(members, labels, reps, docs, BLOCK_MEMBERS), "crossings")
    if more.limit(1).count():
        labels = components.label(links.unionByName(more))
    found = folded.join(labels, folded["rep"] == labels["node"], "left").select(
        "d1", "d2", F.coalesce("label", "rep").alias("class_id")
    )
    return sketches.join(found, ["d1", "d2"]).select("doc_id", "class_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of every class, with all columns: the one with the smallest id.

    Rows without id are told apart by their texts and come after all that have one.
    """
    alone = F.lit(2**62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(2**62 - 1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), alone).alias("__id"), F.struct(*docs.columns).alias("__row"))
    found = classes(rows.select(F.col("__id").alias("doc_id"), F.col("__row.text").alias("text")))
    kept = rows.join(found.select("class_id").distinct(), F.col("__id") == F.col("class_id"), "left_semi")
    first = Window.partitionBy("__id").orderBy(F.xxhash64("__row.text"))
    return kept.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("__row.*")
