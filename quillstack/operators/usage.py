"""Token usage, cost and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import text as T

#: USD for a million tokens.
PRICE_INPUT, PRICE_OUTPUT = 2.0, 12.0


def billable(output: Column, thinking: Column) -> Column:
    return output + thinking


def cost_report(results: DataFrame, price_input: float = PRICE_INPUT, price_output: float = PRICE_OUTPUT) -> DataFrame:
    """One row for results (input_tokens, output_tokens, thinking_tokens); the price of a page is over all pages."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = results.agg(
        total("input_tokens").alias("input_tokens"),
        total(billable(F.col("output_tokens"), F.col("thinking_tokens"))).alias("output_tokens"),
        total("thinking_tokens").alias("thinking_tokens"),
        F.count(F.lit(1)).alias("pages"),
    )
    usd = lambda c, price: F.col(c) / 1e6 * price
    priced = sums.withColumns({"cost_input_usd": usd("input_tokens", price_input), "cost_output_usd": usd("output_tokens", price_output)})
    whole = F.col("cost_input_usd") + F.col("cost_output_usd")
    return priced.withColumns({"cost_total_usd": whole, "cost_per_page_usd": F.when(F.col("pages") == 0, 0.0).otherwise(whole / F.col("pages"))}).drop("pages")


def page_rollup(lines: DataFrame) -> DataFrame:
    """Lines (page_number, index, text, success, tokens, ms) to pages; blank lines do not enter the text."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "text")))
    said = F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: T.strip(t) != "")
    return lines.groupBy("page_number").agg(
        F.array_join(said, "\n").alias("text"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum(billable(F.col("output_tokens"), F.col("thinking_tokens"))).alias("output_tokens"),
        F.sum("thinking_tokens").alias("thinking_tokens"),
        F.sum("ms").alias("ms"),
        F.count_if("success").alias("ok_count"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One row for results (page_number, text, success, truncated, n_uncertain, api_call_ms)."""
    return results.agg(
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("truncated"), F.col("page_number")))), ",").alias("truncated_pages"),
        F.coalesce(F.sum("n_uncertain"), F.lit(0)).alias("uncertain"),
        (F.coalesce(F.sum("api_call_ms"), F.lit(0)) / 1000).alias("seconds"),
    )


def document_summary(results: DataFrame) -> DataFrame:
    """The rows of a document's closing table."""
    one = results.agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("n_uncertain"), F.lit(0)).alias("uncertain"), F.coalesce(F.sum("api_call_ms"), F.lit(0)).alias("ms"))
    return one.select("pages", "failed", "uncertain", F.format_string("%.1f", F.col("ms") / 1000).alias("seconds"))


def punctuated(results: DataFrame) -> DataFrame:
    """Pages the punctuation pass is for: successful and not blank."""
    return results.where(F.col("success") & (T.strip(F.col("text")) != ""))


def diplomatic_dump(results: DataFrame, heading: str = "### עמוד ") -> DataFrame:
    """Pages as blocks of heading and raw text, to be written in page order with a blank line between."""
    return results.select("page_number", F.concat(F.lit(heading), F.col("page_number").cast("string"), F.lit("\n"), F.col("text")).alias("block"))
