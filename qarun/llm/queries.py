"""The queries of this package, each with its SQL where SQL can say the same."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qarun.llm.bpe import digests, encode, read_vocabulary
from qarun.llm.common import as_text, table
from qarun.llm.decontaminate import contaminated
from qarun.llm.exact_dedup import exact_duplicates
from qarun.llm.html_text import extract_pages
from qarun.llm.lexical_search import search
from qarun.llm.line_dedup import dedup_lines
from qarun.llm.near_dedup import near_duplicates
from qarun.llm.periodic_runs import looped, periodic_runs, run_digests
from qarun.llm.quality import score_quality
from qarun.llm.shards import shard_by_bytes
from qarun.llm.toxicity import Model
from qarun.llm.toxicity import fit as fit_toxicity
from qarun.llm.toxicity import toxicity
from qarun.llm.url_rules import WORDS, judge_urls
from qarun.llm.vector_search import search_vectors

# A score of at least this much predicts the label 1.
DECISION = 0.3


def _held_out(folds: int, fold: int) -> Column:
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return number % folds == fold


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~_held_out(5, 0))
    scored = score_quality(table(spark, sf_dir, "documents"), labels)
    return scored.select(
        "doc_id",
        _held_out(5, 0).alias("held_out"),
        "score",
        (F.col("score") >= DECISION).cast("int").alias("predicted"),
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    rows = docs.select("doc_id", F.xxhash64(as_text("text")).alias("text_hash"))
    own = found.select(
        F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "item_ids"
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    return rows.join(own, same, "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
    )


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return digests(encode(table(spark, sf_dir, "documents"), content))


def toxicity_model(spark: SparkSession, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels").filter(~_held_out(4, 2))
    return fit_toxicity(table(spark, sf_dir, "documents"), labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", _held_out(4, 2).alias("held_out"), toxicity(model).alias("score"))
        .withColumn("predicted", (F.col("score") >= DECISION).cast("int"))
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=0.85)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search_vectors(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), change=looped))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_html_text": op2_html_text,
        "op3_decontaminate": op3_decontaminate,
        "op4_url_rules": op4_url_rules,
        "op5_line_dedup": op5_line_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_bpe": op7_bpe,
        "op8_toxicity": op8_toxicity,
        "op9_near_dedup": op9_near_dedup,
        "op10_shards": op10_shards,
        "op11_lexical_search": op11_lexical_search,
        "op12_vector_search": op12_vector_search,
        "op13_periodic_runs": op13_periodic_runs,
    }


SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINES_SQL = f"""
lines AS (
    SELECT doc_id, place, line, translate(trim(line, {SPACES_SQL}), {LOWER_SQL}) AS key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
          FROM documents)),
common AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
    SELECT doc_id, place, line, keeper IS NOT NULL AND doc_id <> keeper AS gone
    FROM lines LEFT JOIN common USING (key))
"""


def _words_sql(rule: str) -> str:
    inner = "[^a-z0-9]+".join(rule.split("-"))
    return f"regexp_matches(lower(host || path), '(?:^|[^a-z0-9]){inner}(?:[^a-z0-9]|$)')"


def _site_sql(site: str) -> str:
    host, _, path = site.partition("/")
    return (
        f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
    )


URLS_SQL = f"""
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN {" OR ".join(_words_sql(rule.rule) for rule in WORDS)} THEN 'block'
            ELSE 'allow' END AS verdict
FROM (SELECT *, CASE WHEN {_site_sql("example.net/en/")} THEN 'example.net/en/'
                     WHEN {_site_sql("example.com/de/")} THEN 'example.com/de/'
                     WHEN {_site_sql("org/fr/")} THEN 'org/fr/'
                     WHEN {_site_sql("net/")} THEN 'net/' END AS rule
      FROM (SELECT page_id,
                   translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), {LOWER_SQL}) AS host,
                   regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
            FROM (SELECT page_id, CASE WHEN contains(url, '://')
                         THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest
                  FROM pages)))
"""


TERMS_SQL = f"""unnest(regexp_extract_all(translate(text, {LOWER_SQL}),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"""

SEARCH_SQL = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {TERMS_SQL} FROM documents)
            GROUP BY doc_id, term),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, total GROUP BY term),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf)
               // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
    FROM (SELECT item_id, {TERMS_SQL} FROM benchmark)
    JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total
    GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored
WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_rules": URLS_SQL,
        "op11_lexical_search": SEARCH_SQL,
        "op5_line_dedup": f"""
            WITH {LINES_SQL}
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                   sha256(coalesce(
                       string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
            FROM judged GROUP BY doc_id""",
        "op6_exact_dedup": f"""
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY bare) AS group_size,
                   doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
            FROM (SELECT doc_id, length(coalesce(text, '')) AS size,
                         translate(coalesce(text, ''), {SPACES_SQL}, '') AS bare FROM documents)
            WINDOW w AS (PARTITION BY bare ORDER BY size DESC, doc_id)""",
    }
