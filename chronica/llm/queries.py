"""Registered queries of the training-data operators: thin digests of their outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronica import session
from chronica.llm import decontamination, merkle, near_dedup, packing, phrases, pii, quality, secret_scan, suffix_dedup, syncmers, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(fn):
    """Register ``fn(spark, sf_dir)`` under its own name."""
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.table(session.tune(spark), sf_dir, name)


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 4096 tokens as best fit decreasing finds."""
    return packing.pack(read(spark, sf_dir, "documents"), special=True)


@query
def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through monolithic archives, members with an index, and back."""
    back = warc.round_trip(spark, read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


TWINS["op6_warc_normaliser"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1)
    FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to,
  true AS intact
FROM r
"""


@query
def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents from the marginals of a conditional random field."""
    out = toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", "held_out", "score", "predicted", text.alias("spans"))


@query
def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a byte-level convolutional network."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets and linked weak parts of all documents."""
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents")))


@query
def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.compare(read(spark, sf_dir, "documents"))


@query
def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal numbers, dates and addresses replaced by pseudonyms.

    The key of a real run comes from a secret store; the query's is for tests."""
    return pii.pseudonymise(read(spark, sf_dir, "documents"), key="op5-test-key")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that lie in documents, all items against all documents."""
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.classes(read(spark, sf_dir, "documents"))


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes removed from all documents; the last column is what is left,
    with characters that a cut split replaced."""
    out = suffix_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, some of them tampered with."""
    out = merkle.manifest(read(spark, sf_dir, "documents"), tampered=merkle.tampered_leaf())
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# The checksum goes bit by bit: DuckDB has no crc32. Levels are built by recursion, and every leaf
# meets the nodes of its run at each level.
TWINS["op11_merkle_manifest"] = """
WITH RECURSIVE bits AS (
  SELECT doc_id, flatten([[CAST(((ascii(c) >> b) & 1) AS BIGINT) FOR b IN range(8)] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]) AS b
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), sums AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda acc, x: xor(acc >> 1, (xor(acc, x) & 1) * 3988292384)), 4294967295) AS crc FROM bits
), fields AS (
  SELECT d.doc_id, coalesce('=' || d.source, '') AS grp,
    coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(d.source) || ':' || d.source, '-')
      || coalesce(strlen(d.lang) || ':' || d.lang, '-') || coalesce(strlen(CAST(d.n_chars AS VARCHAR)) || ':' || d.n_chars, '-') AS head,
    d.text, coalesce(s.crc % 5 = 0, false) AS hit
  FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id
), hashes AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS changed
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM hashes
), lower_tree AS (
  SELECT grp, size, 0 AS lvl, CAST(1 AS HUGEINT) AS span, pos, leaf AS digest FROM leaves
  UNION ALL
  SELECT grp, size, lvl + 1, span * 16, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM lower_tree WHERE size > span GROUP BY grp, size, lvl, span, pos // 16
), subroots AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS size FROM lower_tree WHERE size <= span
), upper_tree AS (
  SELECT size, 0 AS lvl, CAST(1 AS HUGEINT) AS span, pos, subroot AS digest FROM subroots
  UNION ALL
  SELECT size, lvl + 1, span * 16, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM upper_tree WHERE size > span GROUP BY size, lvl, span, pos // 16
), root AS (
  SELECT digest AS root FROM upper_tree WHERE size <= span
), lower_steps AS (
  SELECT l.grp, l.pos, n.lvl, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos < l.pos // n.span), '') AS lefts,
    coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos > l.pos // n.span), '') AS rights
  FROM leaves l JOIN lower_tree n ON n.grp = l.grp AND n.size > n.span AND n.pos // 16 = l.pos // (n.span * 16) GROUP BY 1, 2, 3
), upper_steps AS (
  SELECT s.grp, n.lvl, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos < s.pos // n.span), '') AS lefts,
    coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos > s.pos // n.span), '') AS rights
  FROM subroots s JOIN upper_tree n ON n.size > n.span AND n.pos // 16 = s.pos // (n.span * 16) GROUP BY 1, 2
), paths AS (
  SELECT l.grp, l.pos, coalesce(a.lefts, []) || coalesce(b.lefts, []) AS lefts, coalesce(a.rights, []) || coalesce(b.rights, []) AS rights
  FROM leaves l
  LEFT JOIN (SELECT grp, pos, list(lefts ORDER BY lvl) AS lefts, list(rights ORDER BY lvl) AS rights FROM lower_steps GROUP BY 1, 2) a ON a.grp = l.grp AND a.pos = l.pos
  LEFT JOIN (SELECT grp, list(lefts ORDER BY lvl) AS lefts, list(rights ORDER BY lvl) AS rights FROM upper_steps GROUP BY 1) b ON b.grp = l.grp
), folds AS (
  SELECT l.grp, l.pos, 0 AS k, l.changed AS node, p.lefts, p.rights FROM leaves l JOIN paths p ON p.grp = l.grp AND p.pos = l.pos
  UNION ALL
  SELECT grp, pos, k + 1, sha256(lefts[k + 1] || node || rights[k + 1]), lefts, rights FROM folds WHERE k < len(lefts)
)
SELECT l.doc_id, l.leaf, s.subroot, r.root,
  sha256(array_to_string(list_transform(range(len(f.lefts)), lambda i: f.lefts[i + 1] || f.rights[i + 1]), '')) AS proof_sha256,
  f.node AS folded_root, f.node = r.root AS verified
FROM leaves l JOIN folds f ON f.grp = l.grp AND f.pos = l.pos AND f.k = len(f.lefts) JOIN subroots s ON s.grp = l.grp, root r
"""


@query
def op12_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of 2 to 4 words of every language of all documents."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


TWINS["op12_setm_phrases"] = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest([list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '')
      FOR p IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')]) AS words
    FROM documents)
), grams AS (
  SELECT lang, len, array_to_string(words[i:i + len - 1], ' ') AS phrase
  FROM (SELECT lang, words, len, unnest(range(1, len(words) - len + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS len) AS lens)
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE len = 1 GROUP BY lang
), f AS (
  SELECT lang, len, phrase, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000 * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, len)) AS k FROM f WHERE len > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, len - m + 2)) AS s FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, len)) AS m FROM f WHERE len > 2))
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = s.lang AND p.phrase = s.phrase AND 100 * p.a >= 80 * s.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op13_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id 50 divides."""
    return topk.search(topk.build(read(spark, sf_dir, "embeddings")))


TWINS["op13_pivot_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT r AS qr, vec_id AS query_id, i, e[i] AS x FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM v WHERE vec_id % 50 = 0)
), c AS (
  SELECT r, vec_id, i, e[i] AS x FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM v)
), s AS (
  SELECT qr, query_id, r, vec_id, sum(q.x * c.x) AS score FROM q JOIN c USING (i) WHERE qr <> r GROUP BY ALL
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
