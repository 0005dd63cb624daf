"""The registered queries of this subpackage: thin applications of the operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import compress_quality, langid, mixing, neighbours, ngram_join, piece_sampling, quality_rules, secret_scan, toxicity, url_filter
from gridloom.llm.common import crc_mod, sampled_by_class, table, tune

URL_RULES = [
    url_filter.UrlRule("block", "com", "/en/"),
    url_filter.UrlRule("allow", "example.com", "/en/7"),
    url_filter.UrlRule("allow", "net", "/de/"),
    url_filter.UrlRule("block", "example.net", "/de/8"),
    url_filter.UrlRule("block", "org", "/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES, model, ["page_id"])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of every document: Jaccard similarity of 0.8 or more on five-word shingles."""
    tune(spark)
    return ngram_join.join(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "n_links")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets and the secrets' spans of every document."""
    tune(spark)
    forest = secret_scan.fit(secret_scan.labelled_findings())
    found = secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text", "source"), forest, ["doc_id"], path="source")
    return found.select("doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), "secrets")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    tune(spark)
    docs, held = table(spark, sf_dir, "documents", "doc_id", "text"), crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~held)
    return toxicity.score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"], threshold=0.7)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, difference of every document."""
    tune(spark)
    docs, held = table(spark, sf_dir, "documents", "doc_id", "text"), crc_mod("doc_id", 5) == 0
    model = compress_quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), ~held)
    scored = compress_quality.score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"], threshold=0.3)
    return scored.select("doc_id", "held_out", "score", "predicted", "difference")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document: doc_id, rank, pieces, n_pieces, log_prob, perturbed, threshold, log_inclusion, and whether decoding gives the text."""
    tune(spark)
    return piece_sampling.encode(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], k=2, check=True)


def learned_rules(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> list[quality_rules.Rule]:
    """A decision list from the statistics of about per_class labelled documents of each class, chosen by hash."""
    chosen, _ = sampled_by_class(labels, "doc_id", "quality", per_class)
    chosen = F.broadcast(chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")))
    rows = quality_rules.statistics(docs.join(chosen, "doc_id"), ["doc_id", "quality"])
    return quality_rules.learn([tuple(r) for r in rows.select("doc_id", "quality", *quality_rules.STATISTICS).collect()])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the rule of every document."""
    tune(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rules = learned_rules(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    measured = quality_rules.statistics(docs, ["doc_id"]).withColumn("base_failed", quality_rules.base_failed())
    judged = measured.withColumn("rule", quality_rules.dropped_by(rules))
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"), weights=(5.0, 2.0, 1.0), share=1.0, most=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest rows of every row whose vec_id is divisible by 20."""
    tune(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    tune(spark)
    docs, held = table(spark, sf_dir, "documents", "doc_id", "text", "lang"), crc_mod("doc_id", 4) == 2
    model = langid.fit(docs, ~held)
    return langid.detect(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_ngram_join": op2_ngram_join,
    "op3_secret_scan": op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_pieces": op6_pieces,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_nearest": op9_nearest,
    "op10_language": op10_language,
}
ORACLES: dict[str, str] = {
    "op2_ngram_join": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS g(i) WHERE len(w) > 0
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * k >= 4 * (x.n + y.n)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
        classes AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id)
        SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM classes
    """,
    "op9_nearest": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
        SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
    """,
}
