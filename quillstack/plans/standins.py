"""The corpus relations as the driver's tables play them, in DataFrames and as SQL with the same meaning.

pages: the sources; lines: the documents, in id order; predictions: conversation turns; corrections: labels;
results: a document each, with token counts derived from its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    page = F.regexp_extract("source", "([0-9]+)", 1).cast("bigint")
    path = F.concat(F.lit("lines/"), F.col("doc_id").cast("string"), F.lit(".png"))
    return d.select(F.col("doc_id").alias("id"), page.alias("page_id"), F.col("doc_id").alias("idx"), path.alias("image_path"), F.when(F.col("lang") == "de", "").when(F.col("lang") == "fr", "context.png").alias("context_image_path"), "text", "lang")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).alias("n_lines"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("line_id"), "text", F.col("role").alias("model"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "sic").when(F.col("quality") == 1, "confirm").otherwise("fix")
    text = F.when(kind == "fix", "").otherwise(F.concat(F.lit("label  "), F.col("quality").cast("string"), F.lit(" "), F.col("toxic").cast("string")))
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("line_id"), text.alias("text"), kind.alias("kind"), F.when(kind == "sic", "toxic").alias("note"))


def marked(c: str) -> F.Column:
    """A text with every common word marked as uncertain."""
    return F.regexp_replace(c, " (the|de|la|und|que) ", " [$1?] ")


def hebrew(c: str) -> F.Column:
    """Some Latin letters as Hebrew ones, so that there are lines in both scripts."""
    return F.translate(c, "abcdeh", "אבגדהם")


def ascii_only(c: str) -> F.Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    size = F.length("text")
    return d.select(
        F.col("doc_id").alias("page_number"),
        "text",
        (F.col("lang") != "es").alias("success"),
        (size > 20000).alias("truncated"),
        F.size(F.regexp_extract_all(marked("text"), F.lit(r"\[([^\]]+)\?\]"), F.lit(1))).alias("n_uncertain"),
        (size % 977).alias("api_call_ms"),
        size.alias("input_tokens"),
        F.floor(size / 4).alias("output_tokens"),
        (size % 7).alias("thinking_tokens"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a benchmark item: the items take turns by the document's id."""
    b = read(spark, sf_dir, "benchmark")
    n = b.count()
    left = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("hypothesis"), (F.col("doc_id") % max(n, 1)).alias("item_id"))
    return left.join(b.select("item_id", F.col("text").alias("reference")), "item_id")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation, with some words marked, against the turn before it."""
    t = read(spark, sf_dir, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return t.select("conv_id", "turn", marked("text").alias("hypothesis")).join(before, ["conv_id", "turn"])


#: The same relations as common table expressions.
SQL = r"""
lines AS (SELECT doc_id AS id, CAST(nullif(regexp_extract(source, '[0-9]+'), '') AS BIGINT) AS page_id, doc_id AS idx, 'lines/' || doc_id || '.png' AS image_path,
  CASE lang WHEN 'de' THEN '' WHEN 'fr' THEN 'context.png' END AS context_image_path, text, lang FROM documents),
book AS (SELECT page_id AS id, count(*) AS n_lines FROM lines GROUP BY 1),
predictions AS (SELECT turn AS id, conv_id AS line_id, text, role AS model FROM conversations),
kinds AS (SELECT *, CASE WHEN toxic = 1 THEN 'sic' WHEN quality = 1 THEN 'confirm' ELSE 'fix' END AS kind FROM labels),
corrections AS (SELECT doc_id AS id, doc_id AS line_id, CASE WHEN kind = 'fix' THEN '' ELSE 'label  ' || quality || ' ' || toxic END AS text, kind, CASE WHEN kind = 'sic' THEN 'toxic' END AS note FROM kinds),
marked AS (SELECT doc_id, lang, regexp_replace(text, ' (the|de|la|und|que) ', ' [\1?] ', 'g') AS text FROM documents),
results AS (SELECT d.doc_id AS page_number, d.text, d.lang <> 'es' AS success, length(d.text) > 20000 AS truncated, len(regexp_extract_all(m.text, '\[([^\]]+)\?\]')) AS n_uncertain,
  length(d.text) % 977 AS api_call_ms, length(d.text) AS input_tokens, length(d.text) // 4 AS output_tokens, length(d.text) % 7 AS thinking_tokens FROM documents d JOIN marked m USING (doc_id)),
pairs AS (SELECT d.doc_id, b.item_id, regexp_replace(d.text, '[^\x00-\x7F]', '?', 'g') AS hypothesis, regexp_replace(b.text, '[^\x00-\x7F]', '?', 'g') AS reference
  FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
turns AS (SELECT a.conv_id, a.turn, regexp_replace(a.text, ' (the|de|la|und|que) ', ' [\1?] ', 'g') AS hypothesis, b.text AS reference FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
"""
