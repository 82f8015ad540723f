"""The registered queries of the corpus operators and, where SQL can say it, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.sizing import settle
from plumbline.llm import (
    chosen_path, collision, collocations, hard_negatives, histogram_sort, lang_mixture, markov_secrets, mixing,
    multi_index, packing, pii_crf, pu_quality, url_ratio,
)
from plumbline.llm.common import documents, held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def word_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_harmonic_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), word_tokenizer(), capacity=2048)


@query("op2_pu_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = pu_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pu_quality.scored(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_skip_chain_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii_crf.personal_data(docs, pii_crf.fit(docs))


@query("op4_histogram_sort")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents(spark, sf_dir).select("doc_id", F.octet_length(text).cast("long").alias("n"), F.crc32(text.cast("binary")).alias("text_crc32"),
                                           F.xxhash64(text).alias("text_hash"))
    key = histogram_sort.sort_key([F.col("text_hash")], [F.col("doc_id")])
    return histogram_sort.shard_by_bytes(slim, key, F.col("n") + 1, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_block_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(documents(spark, sf_dir)).taken()


@query("op6_chosen_path")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(documents(spark, sf_dir), words=4, percent=80)


@query("op7_collision_counting")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


@query("op8_markov_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markov_secrets.candidates(documents(spark, sf_dir).select("doc_id", "text"))
    slim = settle(markov_secrets.identifiers(found).drop("text"))
    told = markov_secrets.with_spans(slim, markov_secrets.train(slim))
    counts = [markov_secrets.count_of(F.col("_base"), k).alias(f"n_{kind}") for k, kind in enumerate(markov_secrets.KINDS[:3])]
    return told.select("doc_id", *counts, F.sha2(markov_secrets.written(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
                       markov_secrets.written(F.col("_spans")).alias("spans"))


@query("op9_multi_index", """
    WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
                   FROM embeddings WHERE len(embedding) = 64),
    pairs AS (SELECT q.vec_id AS query_id, a.vec_id AS neighbor_id, CAST(list_sum(list_transform(
                  range(1, 65), lambda i: CASE WHEN q.bits[i] = a.bits[i] THEN 0 ELSE 1 END)) AS INTEGER) AS distance
              FROM codes q JOIN codes a ON q.vec_id <> a.vec_id WHERE q.vec_id % 100 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs)
    SELECT query_id, neighbor_id, distance, rank FROM ranked WHERE rank <= 10""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return multi_index.nearest_codes(vectors, vectors.where("vec_id % 100 = 0"), bits=64, k=10)


@query("op10_language_mixture")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lang_mixture.with_languages(docs.select("doc_id", "text"), lang_mixture.fit(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


# fixed values: the rules of the query
URL_RULES = [url_ratio.Rule("allow", "org", "/"), url_ratio.Rule("block", "example.org", "/es/"),
             url_ratio.Rule("block", "example.org", "/en/1"), url_ratio.Rule("allow", "com", "/fr/"), url_ratio.Rule("block", "com", "/de/")]


@query("op11_url_ratio")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_ratio.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op12_collocations", r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
    lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS words FROM pieces),
    grams AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
              FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM lists, (SELECT unnest(range(1, 6)) AS k))),
    counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
    totals AS (SELECT lang, sum(len(words)) AS n FROM lists GROUP BY lang),
    found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM counted WHERE k > 1),
    cuts AS (SELECT lang, k, phrase, a, words, unnest(range(1, k)) AS cut FROM found),
    valued AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, h.f AS l, t.f AS r, s.n,
                   CAST((CAST(1000 AS HUGEINT) * c.a * s.n) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
               FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = array_to_string(c.words[1:c.cut], ' ')
               JOIN counted t ON t.lang = c.lang AND t.phrase = array_to_string(c.words[c.cut + 1:c.k], ' ') JOIN totals s ON s.lang = c.lang),
    lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    kept AS (SELECT * FROM lowest p WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.lang = p.lang AND o.k > p.k AND 100 * o.a >= 100 * p.a
                 AND contains(' ' || o.phrase || ' ', ' ' || p.phrase || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), support=100, longest=5, most=2000)


@query("op13_hard_negatives", """
    WITH fit AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS anchor_id, o.vec_id AS other, q.label = o.label AS same,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * o.v[i])) AS BIGINT) AS score
               FROM fit q JOIN fit o ON q.vec_id <> o.vec_id AND len(q.v) = len(o.v) WHERE q.vec_id % 50 = 0),
    positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
    met AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
                s.other AS negative_id, p.positive_score, s.score AS negative_score
            FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
                AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
    SELECT * FROM met WHERE rank <= 3""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(moved, F.col("vec_id") % 50 == 0)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
