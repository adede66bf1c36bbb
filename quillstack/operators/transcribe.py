"""Model calls as batch functions: a client is made once a task, failures become rows, and nothing is dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions import text as T

RESULT = "page_number bigint, text string, success boolean, error_message string, finish_reason string, input_tokens int, output_tokens int, thinking_tokens int"
Client = Callable[[bytes], dict]


def offline_client() -> Client:
    """A stand-in without network: content that is UTF-8 is its own transcription."""
    return lambda content: {"text": content.decode(), "finish_reason": "STOP", "input_tokens": len(content), "output_tokens": len(content) // 4, "thinking_tokens": None}


def transcribe(pages: DataFrame, make_client: Callable[[], Client] = offline_client) -> DataFrame:
    """pages (page_number, content) -> RESULT, uncertain words, language and whether the answer was cut off."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for number, content in zip(batch["page_number"], batch["content"], strict=True):
                try:
                    said = client(content)
                    raw = said.get("text") or ""
                    rows.append((number, raw.strip(), bool(raw), None, said.get("finish_reason"), *(int(said.get(k) or 0) for k in ("input_tokens", "output_tokens", "thinking_tokens"))))
                except Exception as e:  # a page that fails is a row that says so
                    rows.append((number, "", False, str(e), None, 0, 0, 0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    done = pages.select("page_number", "content").mapInPandas(call, RESULT)
    label = F.when(F.col("error_message").isNotNull(), T.error_label(F.col("error_message")))
    return done.withColumns({"uncertain_words": T.uncertain_words(F.col("text")), "detected_language": T.language(F.col("text")), "truncated": T.truncated(F.col("finish_reason")), "error_label": label})


def accept_punctuation(results: DataFrame, punctuated: str = "punctuated") -> DataFrame:
    """results (text, success, punctuated): the punctuated text where it changes nothing but punctuation, else the original."""
    text, new = F.col("text"), F.col(punctuated)
    asked = F.col("success") & (T.strip(text) != "") & (T.strip(F.coalesce(new, F.lit(""))) != "")
    ok = F.coalesce(asked & (T.skeleton(text) == T.skeleton(new)), F.lit(False))
    return results.withColumns({"ok": ok, "text": F.when(ok, new).otherwise(text)})
