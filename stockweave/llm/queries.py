"""The registered queries op1 to op13 and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, difference_cover, filter_audit, language, packing, pii, pivots, rank_bpe, recompression, simhash, token_files, toxicity
from .common import new_folder
from .wordpieces import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
UPPER, LOWER = decontaminate.UPPER, decontaminate.LOWER


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query("op1_pivot_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op2_recompression_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS s, w FROM d),
k AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS window_text FROM p),
m AS (SELECT window_text, min(doc_id) AS first FROM k GROUP BY window_text),
h AS (SELECT DISTINCT doc_id, s + unnest(range(0, 50)) AS pos FROM k JOIN m USING (window_text) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
f AS (
  SELECT u.doc_id, count(h.pos) AS n_removed, string_agg(u.word, ' ' ORDER BY u.pos) FILTER (h.pos IS NULL) AS kept
  FROM u LEFT JOIN h ON u.doc_id = h.doc_id AND u.pos = h.pos GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN f ON d.doc_id = f.doc_id""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return recompression.without_repeats(read(spark, folder, "documents")).drop("kept")


@query("op3_pii_boosting")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(read(spark, folder, "documents")).drop("th", "clean")


@query("op4_range_coded_ids")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    target = new_folder(spark, "token-files")
    token_files.write_token_files(read(spark, folder, "documents"), target, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, target).drop("ids")


@query("op5_simhash_anchors")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op6_positional_index", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS window_text FROM bs),
ns AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n),
o AS (SELECT doc_id, s, ds.n, item_id FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS window_text FROM ds) ds JOIN bw USING (window_text, n)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, s + unnest(range(0, n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM o)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("th")


@query("op7_sum_of_squares_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


@query("op8_compression_language")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs, fold = read(spark, folder, "documents"), toxicity.fold(parts=4)
    found = language.languages(docs, language.learn_dictionaries(docs, fold != 2))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op9_boosted_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs, fold = read(spark, folder, "documents"), toxicity.fold(parts=5)
    model = toxicity.fit_toxicity(docs, read(spark, folder, "labels"), fold != 0)
    return toxicity.toxicity(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op10_difference_cover_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return difference_cover.without_repeats(read(spark, folder, "documents")).drop("kept")


@query("op11_rank_bpe")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = rank_bpe.decoded(rank_bpe.encoded(read(spark, folder, "documents"), path, pattern), path, pattern)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op12_token_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.token_alignment(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return found.drop("th")


@query("op13_filter_audit", r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < w.doc_id, FALSE)::INT AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(range(0, 5)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT array_to_string(list_transform(p, lambda i: substr('ABCDE', i + 1, 1)), '') AS filter_order, k + 1 AS step, CAST(1 << p[k + 1] AS INT) AS own,
    CAST(coalesce(list_sum(list_transform(p[1:k], lambda i: 1 << i)), 0) AS INT) AS earlier
  FROM o, (SELECT i AS k FROM x)),
r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, folder, "documents"), read(spark, folder, "labels"))
