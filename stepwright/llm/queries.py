"""The registered queries of the operators in this subpackage; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.llm import (
    decontamination, language, lexical, mixing, sharding, simhash, substrings, token_counts, token_files, tokens, topk,
    toxicity, url_filter, whitening)
from stepwright.llm.common import remainder
from stepwright.sources.workspace import new_path

MAX_TOKENS = 1024
SHARDS = 40
END_ID = 2


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call starts with an empty cache of its own, so that every distinct text is encoded."""
    counted = token_counts.count_tokens(
        _docs(spark, sf_dir), tokens.file_of("byte_bpe_50k.json"), new_path(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_docs(spark, sf_dir), SHARDS, seed=42).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(_docs(spark, sf_dir), path, tokens.file_of("word_bpe_49k.json"), END_ID)
    return token_files.read_digests(spark, path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), 5) != 0)
    lexicon = toxicity.learn(docs, labels)
    return toxicity.score(docs, lexicon).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, 5, "vec_id % 50 = 0", scale=256)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "lang").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    found = language.identify(docs, docs.where("not held_out"), F.col("lang"), keep=["held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


#: Weights of the domains that the quality labels make.
TARGETS = {"good": 0.9, "plain": 0.1}


def domain() -> Column:
    return F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(_docs(spark, sf_dir), labels, domain(), TARGETS).select(
        "doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)], "rate")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(_docs(spark, sf_dir), length=100)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir), shingle=3).select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(
        _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


#: Host, path, verdict: the rules of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted in all texts of `documents`; the urls that a rule decides are the labelled ones."""
    words = url_filter.word_counts(_docs(spark, sf_dir))
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, words)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's offset of a million cancels in every column, so the operator needs none."""
    white = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16, scale=64)
    longest = F.lit(2**63 - 1).cast("decimal(38,0)")
    return white.select(
        "vec_id", "n", F.least("deviation", longest).cast("bigint").alias("deviation"), "identity_error", "explained",
        F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("at")).alias("explained"), "identity_error")


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_toxicity, op3_exact_topk, op4_sharding, op5_token_files, op6_language, op7_mixing,
    op8_suffix_dedup, op9_simhash, op10_decontamination, op11_lexical_search,
    op12_url_filter, op13_whitening)}


def _words(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


def _terms(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")


ORACLES = {
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
          FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_lexical_search": f"""
        WITH dt AS (SELECT row_number() OVER () AS row, doc_id, {_terms('text')} AS t FROM documents),
        it AS (SELECT row_number() OVER () AS item, item_id, {_terms('text')} AS t FROM benchmark),
        s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM dt WHERE len(t) > 0),
        tf AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n
          FROM (SELECT row, doc_id, unnest(t) AS term, len(t) AS n FROM dt) GROUP BY row, term),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
          FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
        q AS (SELECT item, any_value(item_id) AS item_id, term, count(*) AS times
          FROM (SELECT item, item_id, unnest(t) AS term FROM it) GROUP BY item, term),
        r AS (SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
            sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
          FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY item, row),
        k AS (SELECT item_id, doc_id, score,
            row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
          FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
        i AS (SELECT item_id::VARCHAR AS item, {_words('text')} AS w, least(len({_words('text')}), 13) AS n FROM benchmark),
        iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS t
          FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i WHERE n > 0)),
        dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
            FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        h AS (SELECT DISTINCT doc_id, dw.n, k, item FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
        s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(items, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id""",
}
