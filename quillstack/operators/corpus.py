"""The corpus store: pages, lines, append-only predictions, at most one correction a line.

Reads are declarative joins; writes are pure functions from a state and a change log to a new state.
Keep-last always goes by a sequence number, never by a timestamp, whose resolution is a second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import text as T
from quillstack.operators.numbering import number_rows

KINDS = ("confirm", "fix", "sic")
TARGET_WORDS = 10_000


def latest_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("line_id").agg(F.max_by("text", "id").alias("prediction"))


def review_lines(lines: DataFrame, predictions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Every line with its latest prediction and its correction, if any."""
    fixed = corrections.select("line_id", F.col("text").alias("correction"), "kind", "note")
    joined = lines.withColumnRenamed("id", "line_id").join(latest_predictions(predictions), "line_id", "left").join(fixed, "line_id", "left")
    shown = F.when(F.length("correction") > 0, F.col("correction")).otherwise(F.coalesce("prediction", F.lit("")))
    return joined.withColumns({"prediction": F.coalesce("prediction", F.lit("")), "reviewed": F.col("correction").isNotNull(), "shown": shown})


def pages_reviewed(pages: DataFrame, lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Pages with the number of their reviewed lines, newest first."""
    counts = lines.select(F.col("id").alias("line_id"), "page_id").join(corrections.select("line_id"), "line_id").groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).alias("reviewed"))
    return pages.join(counts, "id", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(0))).orderBy(F.desc("id"))


def corpus_stats(pages: DataFrame, lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row: counts, words by the spaces rule, progress towards the target."""
    reviewed = corrections.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("kind") == "sic").alias("sic"), F.coalesce(F.sum(T.spaces_plus_one(F.col("text")).cast("long")), F.lit(0)).alias("words"))
    one = pages.agg(F.count(F.lit(1)).alias("pages")).join(lines.agg(F.count(F.lit(1)).alias("lines"))).join(reviewed)
    progress = F.least(F.lit(100.0), F.round(100 * F.col("words") / TARGET_WORDS, 1))
    return one.withColumns({"target_words": F.lit(TARGET_WORDS), "progress": progress})


def page_done(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    joined = lines.select(F.col("id").alias("line_id"), "page_id").join(corrections.select("line_id", F.lit(True).alias("hit")), "line_id", "left")
    return joined.groupBy("page_id").agg(F.count_if(F.col("hit")).alias("done"), F.count(F.lit(1)).alias("lines"))


def review_cursor(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per page: the first line that is not reviewed, else the first line."""
    joined = lines.select(F.col("id").alias("line_id"), "page_id", "idx").join(corrections.select("line_id", F.lit(True).alias("hit")), "line_id", "left")
    return joined.groupBy("page_id").agg(F.coalesce(F.min(F.when(F.col("hit").isNull(), F.col("idx"))), F.min("idx")).alias("cursor"))


def inferred_kind(new: Column, initial: Column, sic: Column) -> Column:
    """What a save means: marked as the writer's own error, unchanged, or changed."""
    return F.when(sic, "sic").when(T.strip(new) == T.strip(initial), "confirm").otherwise("fix")


def checked_kind(kind: Column) -> Column:
    """The kind, 'fix' by default; any other value fails the query."""
    given = F.coalesce(kind, F.lit("fix"))
    return F.when(given.isin(*KINDS), given).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), given)).cast("string"))


def upsert_corrections(corrections: DataFrame, changes: DataFrame) -> DataFrame:
    """corrections (id, line_id, text, kind, note), changes (seq, line_id, text, kind, note) -> the new state.

    A line's correction keeps the id it got first; of its changes the last one holds."""
    saved = changes.select("line_id", "seq", T.strip(F.col("text")).alias("text"), checked_kind(F.col("kind")).alias("kind"), F.nullif(T.strip(F.col("note")), F.lit("")).alias("note"))
    last = saved.groupBy("line_id").agg(F.min("seq").alias("first_seq"), F.max_by(F.struct("text", "kind", "note"), "seq").alias("new"))
    joined = corrections.join(last, "line_id", "full")
    pick = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("line_id", F.coalesce("id", "first_seq").alias("id"), pick("text"), pick("kind"), pick("note"))


def keep_last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of rows with equal keys the one of the greatest sequence number, by aggregation alone."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("last")).select(*keys, "last.*")


def replace_lines(lines: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines, incoming (id, page_id, idx, ...) -> the new lines, and the ids of the lines replaced. A line that
    comes again is a new line: it has a new id, and what hung on the old one goes (see cascade)."""
    both = lines.unionByName(incoming)
    kept = keep_last(both, ["page_id", "idx"], "id").select(*lines.columns)
    return kept, both.select("id").join(kept.select("id"), "id", "left_anti")


def cascade(children: DataFrame, gone: DataFrame, key: str = "line_id") -> DataFrame:
    """Children whose parent has not been deleted."""
    return children.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def page_line_counts(pages: DataFrame, lines: DataFrame) -> DataFrame:
    counts = lines.groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return pages.join(counts, "id", "left").withColumn("n_lines", F.coalesce("n", "n_lines")).drop("n")


def padded(number: Column, digits: int) -> Column:
    """A number with leading zeros; one of more digits keeps them all."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))


def asset_paths(lines: DataFrame) -> DataFrame:
    """Where images of pages, lines and contexts lie."""
    page, line = padded(F.col("page_id"), 5), padded(F.col("idx"), 3)
    name = F.concat(F.lit("p"), page, F.lit("_l"), line)
    return lines.withColumns({"page_path": F.concat(F.lit("page"), page, F.lit(".png")), "line_path": F.concat(name, F.lit(".png")), "context_path": F.concat(name, F.lit("_ctx.png"))})


def image_shown(lines: DataFrame) -> DataFrame:
    return lines.withColumn("shown_path", F.coalesce(F.nullif("context_image_path", F.lit("")), F.col("image_path")))


def training_rows(lines: DataFrame, corrections: DataFrame, images: DataFrame) -> DataFrame:
    """Numbered training pairs in page order. Numbers are given before lines without an image drop out."""
    joined = corrections.select("line_id", "text").join(lines.select(F.col("id").alias("line_id"), "page_id", "idx", "image_path"), "line_id")
    numbered = number_rows(joined, "page_id", "idx", "line_id")
    present = numbered.join(images.select("image_path"), "image_path", "left_semi")
    name = F.concat(padded(F.col("number"), 5), F.lit(".png"))
    return present.select("number", "line_id", name.alias("file"), T.export_label(F.col("text")).alias("label"), F.size(T.words(F.col("text"))).alias("words"))
