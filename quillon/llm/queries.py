"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .hmm import hmm_scores
from .jaccard_join import jaccard_join
from .language import language_of_pages
from .lexical import ranked_search
from .mixing import mix
from .pii import find_personal_data
from .quality import quality
from .simhash_join import simhash_groups
from .token_rollup import TokenRollup, counted
from .toxicity import toxicity

CONTRACT = {
    "op2_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"],
    "op5_block_naming": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op9_token_combinations": ["doc_id", "n_shingles", "component_id"],
    "op12_covering_hashing": ["doc_id", "fingerprint", "component_id"],
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents")).select(*CONTRACT["op2_personal_data"])


def op3_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).select(*CONTRACT["op5_block_naming"])


def op6_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_pages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op7_proportional_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(read(spark, sf_dir, "documents"))


def op9_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents")).select(*CONTRACT["op9_token_combinations"])


def op10_delta_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under two tokenizer versions; documents labelled of low quality are deleted; those
    labelled toxic get revised counts (one end token more); every batch is then delivered a second time."""
    rollup, labels = TokenRollup(spark), read(spark, sf_dir, "labels")
    new = counted(read(spark, sf_dir, "documents")).withColumn("seq", F.lit(0))
    rollup.commit("insert", new)
    kinds = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    gone = kinds.filter("quality = 0").select("doc_id", *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "version")), F.lit(None).cast("long").alias("n_tokens"), F.lit(0).alias("seq"))
    rollup.commit("delete", gone)
    revised = rollup.ledger().join(kinds.filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source", "lang", "version", (F.col("tokens") + 1).alias("n_tokens"), F.lit(0).alias("seq"))
    rollup.commit("revise", revised)
    for again, rows in (("insert", new), ("delete", gone), ("revise", revised)):
        if rollup.commit(again, rows):
            raise RuntimeError(f"batch {again} was taken twice")
    return rollup.totals()


def op11_inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7, the label is the next one of ten; rows whose vec_id is divisible by 100 are anchors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, F.col("id") % 100 == 0)


def op12_covering_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents")).select(*CONTRACT["op12_covering_hashing"])


def op13_heap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_string_tiling, op2_personal_data, op3_factorization_machine, op4_quadratic_discriminant, op5_block_naming, op6_evidence_fusion, op7_proportional_fitting, op8_hidden_markov, op9_token_combinations, op10_delta_rollups, op11_inverted_lists, op12_covering_hashing, op13_heap_merge)
}

#: DuckDB twins where plain SQL says the same.
ORACLE_SQL = {
    "op5_block_naming": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g USING (text)
    """,
    # Equal sets are one node; nodes that share a shingle are counted, linked, and joined up by what they reach.
    "op9_token_combinations": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))) END AS shingles FROM w
        ), node AS (
            SELECT min(doc_id) AS id, shingles, len(shingles) AS n FROM s GROUP BY shingles
        ), token AS (
            SELECT id, n, unnest(shingles) AS shingle FROM node
        ), link AS (
            SELECT a.id AS a, b.id AS b FROM token a JOIN token b ON a.shingle = b.shingle AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach(id, low) AS (
            SELECT id, id FROM node UNION SELECT e.b, r.low FROM reach r JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) e ON e.a = r.id
        ), comp AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
        SELECT s.doc_id, node.n AS n_shingles, CASE WHEN node.n = 0 THEN s.doc_id ELSE comp.low END AS component_id
        FROM s JOIN node USING (shingles) JOIN comp ON comp.id = node.id
    """,
    "op11_inverted_lists": """
        WITH v AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
        ), p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score, own FROM s WHERE label = own
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
        QUALIFY rank <= 5
    """,
    "op13_heap_merge": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
        ), q AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL
        ), total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
        m AS (SELECT doc_id, terms, 100 - 25 + (25 * len(terms) * n_docs) // n_terms AS m FROM d, total WHERE len(terms) > 0),
        p AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM m) GROUP BY doc_id, m, term),
        w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY term, n_docs),
        s AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, doc_id
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
    """,
}
