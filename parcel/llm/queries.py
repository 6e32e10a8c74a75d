"""The corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.llm.common import table


def vocabulary(name: str) -> str:
    """A public vocabulary file; other files are passed to the operators as paths."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.bpe import encode_documents
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.shard import shard
    placed = shard(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op4_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.toxic import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.topk import top_k
    return top_k(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op8_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.license import scan
    return scan(table(spark, sf_dir, "documents"))


def op6_suffix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before, lines deleted, the deleted spans and the text that stays."""
    from parcel.llm.linedup import dedup_lines
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform(F.coalesce("line_spans", F.expr(
        "cast(array() as array<struct<first:int,last:int>>)")),
        lambda s: F.concat_ws("-", s["first"], s["last"]))
    return done.select("doc_id", "lines_before", "lines_deleted",
                       F.array_join(spans, ",").alias("deleted_spans"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.exact import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.hpylm import language_scores
    return language_scores(table(spark, sf_dir, "documents"))


def op11_subvector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.subvector import clusters_with_inertia
    return clusters_with_inertia(table(spark, sf_dir, "embeddings"))


def op12_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.fingerprint import fingerprints, near_copies
    docs = table(spark, sf_dir, "documents")
    hexed = lambda c: F.lower(F.hex(c))
    return near_copies(fingerprints(docs), docs).select(
        "doc_id", "n_chars", "edited_sha256", hexed("places").alias("fingerprint"),
        hexed("edited_places").alias("edited_fingerprint"), "near_edited", "near_next",
        "group_id", "n_links")


def op13_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcel.llm.whiten import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


def cluster_oracle(k: int = 8, rounds: int = 10) -> str:
    """Every round as three tables: distances to all centroids, sums per cluster, centroids."""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding,
             lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
             WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding,
             lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1
             AS c, q FROM v QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT uid, min({{'d': CAST(list_sum(list_transform(
             list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c.c}}) AS m
             FROM v, c{r} c GROUP BY uid)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT a.m.c AS c, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n
             FROM a{r} a JOIN v USING (uid), range(1, 65) t(i) GROUP BY a.m.c, i),
         m{r} AS (SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS q FROM s{r} GROUP BY c),
         c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{r} o LEFT JOIN m{r} m
             ON m.c = o.c)""")
    return "WITH " + ",\n         ".join(parts) + f"""
        SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance,
               CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (uid) JOIN c{rounds} c ON c.c = m.c"""


def license_oracle() -> str:
    """Base places by word lists, and containment of every (line, template) pair."""
    from parcel.llm.license import PHRASES, TEMPLATES, THRESHOLD, WORD, word_set
    low = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
           "'abcdefghijklmnopqrstuvwxyz')")
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"('{n}', {word_set(t)!r})" for n, t in TEMPLATES.items())
    return f"""
        WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {low} AS low FROM documents),
             w AS (SELECT *, regexp_extract_all(low, '{WORD}') AS words FROM d),
             p(phrase, label, k) AS (VALUES {phrases}),
             s AS (SELECT uid, words, unnest(range(1, len(words) + 1)) AS i FROM w),
             hit AS (SELECT uid, i - 1 AS place, label FROM s JOIN p
                     ON array_to_string(words[i:i + k - 1], ' ') = phrase),
             base AS (SELECT uid, count(*) AS n, min(place) AS lo, max(place) AS hi,
                             list_sort(list(DISTINCT label)) AS labels FROM hit GROUP BY uid),
             t(template, tw) AS (VALUES {templates}),
             b AS (SELECT uid, list_distinct(regexp_extract_all(line, '{WORD}')) AS bw FROM (
                   SELECT uid, unnest(string_split(low, chr(10))) AS line FROM d)),
             m AS (SELECT uid, template, max(len(list_intersect(tw, bw)) / len(tw)) AS c
                   FROM b JOIN t ON len(list_intersect(tw, bw)) >= ceil({THRESHOLD} * len(tw) - 1e-9)
                   GROUP BY uid, template),
             best AS (SELECT uid, max(c) AS c, list(template) AS found FROM m GROUP BY uid)
        SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word,
               hi AS last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(
                   coalesce(base.labels, []), coalesce(found, [])))), ','), '') AS labels,
               CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
        FROM w LEFT JOIN base USING (uid) LEFT JOIN best USING (uid)"""


QUERIES = {f.__name__: f for f in (op1_bpe_roundtrip, op2_splitter_shards, op3_lsh_forest, op4_subsequence_svm,
                                   op5_block_topk, op6_suffix_lines,
                                   op7_slack_packing, op8_license_join,
                                   op9_extendible_dedup, op10_pitman_yor,
                                   op11_subvector_clusters, op12_minhash_fingerprints,
                                   op13_cholesky_whitening)}
ORACLE: dict[str, str] = {
    "op2_splitter_shards": r"""
WITH tbl AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
     b AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(strlen(text), 0) + 1 AS size,
                  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                 lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
     r AS (SELECT doc_id, size, md5(body) AS k, xor(list_reduce(list_prepend(4294967295, bytes),
                  lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
           FROM b, tbl),
     p AS (SELECT *, sum(size) OVER w - size AS start, sum(size) OVER () AS total,
                  row_number() OVER w - 1 AS i
           FROM r WINDOW w AS (ORDER BY k, coalesce(doc_id, -9223372036854775808), text_crc32, size
                               ROWS UNBOUNDED PRECEDING)),
     s AS (SELECT *, CAST((2 * start + size) * 16 // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       i - min(i) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op3_lsh_forest": r"""
WITH RECURSIVE
     d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
     s AS (SELECT uid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(w) - 3),
                       lambda i: array_to_string(w[i:i + 4], ' '))) END) AS shingle FROM d),
     n AS (SELECT uid, count(*) AS n FROM s GROUP BY uid),
     i AS (SELECT a.uid AS u, b.uid AS v, count(*) AS c FROM s a JOIN s b
           ON a.shingle = b.shingle AND a.uid < b.uid GROUP BY a.uid, b.uid),
     e AS (SELECT u, v FROM i JOIN n x ON x.uid = u JOIN n y ON y.uid = v
           WHERE 100 * c >= 75 * (x.n + y.n - c)),
     link AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
     r AS (SELECT uid, doc_id FROM d UNION SELECT link.v, r.doc_id FROM r JOIN link ON link.u = r.uid)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.doc_id) AS component_id,
       d.doc_id IS NOT DISTINCT FROM min(r.doc_id) AS kept
FROM d LEFT JOIN n USING (uid) JOIN r USING (uid) GROUP BY d.uid, d.doc_id""",
    "op6_suffix_lines": r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, string_split(coalesce(text, ''), chr(10)) AS body
           FROM documents),
     l AS (SELECT uid, doc_id, unnest(body) AS line, unnest(range(len(body))) AS no FROM d),
     f AS (SELECT *, len(regexp_extract_all(line, '\S+')) AS words FROM l),
     o AS (SELECT uid, doc_id, line, no, words, row_number() OVER (PARTITION BY uid ORDER BY no) AS i,
                  count(*) OVER (PARTITION BY line) AS n FROM f WHERE words > 0),
     p AS (SELECT *, i - row_number() OVER (PARTITION BY uid ORDER BY i) AS run FROM o WHERE n > 1),
     q AS (SELECT *, sum(words) OVER (PARTITION BY uid, run ORDER BY i) AS stop FROM p),
     w AS (SELECT a.uid, a.doc_id, a.i AS a, min(b.i) AS b FROM q a JOIN q b ON a.uid = b.uid
             AND a.run = b.run AND b.i >= a.i AND b.stop - a.stop + a.words >= 50 GROUP BY ALL
           UNION SELECT b.uid, b.doc_id, max(a.i), b.i FROM q a JOIN q b ON a.uid = b.uid
             AND a.run = b.run AND b.i >= a.i AND b.stop - a.stop + a.words >= 50
           GROUP BY b.uid, b.doc_id, b.i),
     k AS (SELECT w.uid, w.doc_id, a, b, string_agg(line, chr(10) ORDER BY i) AS run
           FROM w JOIN q ON q.uid = w.uid AND q.i BETWEEN a AND b GROUP BY w.uid, w.doc_id, a, b),
     c AS (SELECT *, first_value(uid) OVER v AS uid0, first_value(a) OVER v AS a0 FROM k
           WINDOW v AS (PARTITION BY run ORDER BY doc_id, uid, a)),
     g AS (SELECT DISTINCT q.uid, q.i, q.no FROM c JOIN q ON q.uid = c.uid AND q.i <= b AND q.i >=
             CASE WHEN c.uid = uid0 AND a <= a0 + b - a THEN a0 + b - a + 1 ELSE a END
           WHERE c.uid <> uid0 OR a <> a0),
     h AS (SELECT *, i - row_number() OVER (PARTITION BY uid ORDER BY i) AS island FROM g),
     s AS (SELECT uid, min(no) AS lo, max(no) AS hi, count(*) AS lines FROM h GROUP BY uid, island),
     t AS (SELECT uid, sum(lines) AS deleted, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS spans
           FROM s GROUP BY uid),
     x AS (SELECT l.uid, string_agg(line, chr(10) ORDER BY no) AS kept FROM l
           WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.uid = l.uid AND l.no BETWEEN lo AND hi) GROUP BY l.uid)
SELECT doc_id, CAST(len(body) AS BIGINT) AS lines_before, CAST(coalesce(deleted, 0) AS BIGINT) AS lines_deleted,
       coalesce(spans, '') AS deleted_spans, sha256(coalesce(kept, '')) AS text_sha256
FROM d LEFT JOIN t USING (uid) LEFT JOIN x USING (uid)""",
    "op8_license_join": license_oracle(),
    "op11_subvector_clusters": cluster_oracle(),
    "op5_block_topk": """
        WITH v AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding,
                          lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding,
                          lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS (SELECT a.uid, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(
                          list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
                   FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 20 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)
                          AS rank FROM p)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_extendible_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
}
