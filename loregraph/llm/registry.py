"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loregraph.llm import (
    centroids, decontaminate, exact_dedup, language_id, line_dedup, ngram_join, packing, quality, resampling, sharding, simhash, token_counts, wavelet,
)
from loregraph.llm._scratch import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_report(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(documents(spark, sf_dir))


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_report(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op12_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample_report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_wavelet_tokens": op1_wavelet_tokens,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_extendible_shards": op3_extendible_shards,
        "op4_quality": op4_quality,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_language_id": op7_language_id,
        "op8_token_counts": op8_token_counts,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_decontaminate": op10_decontaminate,
        "op11_simhash": op11_simhash,
        "op12_annulus_clusters": op12_annulus_clusters,
        "op13_importance_resampling": op13_importance_resampling,
    }


OP3_SQL = """
WITH h AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
cells AS (SELECT doc_id, h, d, h >> (60 - d) AS p, bytes FROM h, (SELECT unnest(range(0, 61)) AS d)),
sizes AS (SELECT d, p, sum(bytes) AS b, count(*) AS n FROM cells GROUP BY d, p),
own AS (
  SELECT doc_id, h, min(cells.d) AS depth
  FROM cells JOIN sizes USING (d, p) WHERE b <= 2097152 OR n = 1 GROUP BY doc_id, h)
SELECT doc_id, 'b' || CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(h >> (60 - depth)), CAST(depth AS BIGINT)) END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(b AS BIGINT) AS shard_bytes
FROM own JOIN sizes ON sizes.d = own.depth AND sizes.p = own.h >> (60 - own.depth)
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

#: From the definition: pairs of equal lines, the diagonals that they lie on, the unbroken runs of each, and all lines of those of enough weight.
OP6_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
words AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM raw),
d AS (SELECT doc_id, pos, line, greatest(n, 17) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM words WHERE n > 0),
pairs AS (
  SELECT a.doc_id, b.doc_id AS source, a.i - b.i AS shift, a.i, a.w FROM d a JOIN d b USING (line)
  WHERE b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i)),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, source, shift ORDER BY i) AS run FROM pairs),
heavy AS (SELECT doc_id, min(i) AS lo, max(i) AS hi FROM islands GROUP BY doc_id, source, shift, run HAVING sum(w) >= 50),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(lo, hi + 1)) AS i FROM heavy)),
marked AS (
  SELECT words.doc_id, words.pos, words.line, d.i IS NOT NULL AS has_words, gone.i IS NOT NULL AS dead
  FROM words LEFT JOIN d USING (doc_id, pos) LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.i = d.i),
near AS (
  SELECT *, last_value(CASE WHEN has_words THEN dead END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above,
         first_value(CASE WHEN has_words THEN dead END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below
  FROM marked),
cut AS (SELECT doc_id, pos, line, coalesce(above AND below, false) AS cut FROM near)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN cut THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS text_sha256
FROM cut GROUP BY doc_id
"""

OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
hit AS (SELECT p.doc_id, p.i, p.k, win.item FROM pos p JOIN win ON p.g = win.g AND p.k = win.k),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round is a table of its own: nearest centroids, then exact floors of the means."""

    def placed(r: int) -> str:
        return f"""
p{r} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(c, [CAST(d AS HUGEINT), CAST(c AS HUGEINT)]) AS c, min(d) AS d FROM (
    SELECT rid, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS d FROM ints, c{r})
  GROUP BY rid, vec_id, v)"""

    def moved(r: int) -> str:
        return f"""
m{r} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM (
    SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n FROM p{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c))"""

    start = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ints AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(x, lambda e: CAST(floor(1024 * e) AS BIGINT)) AS v FROM kept),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS INTEGER) AS c, v AS w FROM ints
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) <= {k})"""
    steps = [x for r in range(rounds) for x in (placed(r), moved(r))]
    return ",".join([start, *steps, placed(rounds)]) + f"""
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM p{rounds} JOIN c{rounds} USING (c)
"""


OP12_SQL = _clusters_sql()

OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(0, 8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END, n) ORDER BY n) AS t
  FROM (SELECT unnest(range(0, 256)) AS n)),
texts AS (SELECT doc_id AS id, 'd' AS kind, text FROM documents UNION ALL SELECT item_id, 'b', text FROM benchmark),
w AS (
  SELECT row_number() OVER () AS rid, id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feature AS (
  SELECT rid, kind, unnest(w) AS f FROM w UNION ALL
  SELECT rid, kind, w[i] || ' ' || w[i + 1] FROM (SELECT rid, kind, w, unnest(range(1, len(w))) AS i FROM w)),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(
    list_transform(range(0, strlen(f)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256), 4294967295)) % 10000 AS bucket
  FROM (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM feature)), crc_table),
found AS (SELECT rid, kind, bucket FROM feature JOIN hashed USING (f)),
counts AS (
  SELECT bucket, CAST(count(*) FILTER (kind = 'd') AS DOUBLE) AS s, CAST(count(*) FILTER (kind = 'b') AS DOUBLE) AS t FROM found GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (total + 10000)) / ((s + 1) * (wanted + 10000)))) AS BIGINT) AS g
  FROM counts, (SELECT sum(s) AS total, sum(t) AS wanted FROM counts)),
mean AS (SELECT rid, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM found JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY rid),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
         coalesce((g - ((g % n) + n) % n) // n, 0) + CAST(floor(-1000 * ln(-ln((
           CAST('0x' || substr(sha256('7:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN mean USING (rid) WHERE kind = 'd'),
placed AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS r,
         25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN r <= drawn THEN r END AS BIGINT) AS rank
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_extendible_shards": OP3_SQL,
        "op5_exact_dedup": OP5_SQL,
        "op6_line_dedup": OP6_SQL,
        "op10_decontaminate": OP10_SQL,
        "op12_annulus_clusters": OP12_SQL,
        "op13_importance_resampling": OP13_SQL,
    }
