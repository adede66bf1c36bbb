"""Substring dedup: removal of every passage of WINDOW words that starts anywhere else in the corpus.

Suffix automata of reference shards would have to be sent to every document for every shard, which is
quadratic when the reference is the corpus itself; so repeats are found by hashes in two exact steps.

1. Anchors. In every window the least hash of its ANCHOR-word runs is content-chosen, so two equal windows
   have equal anchors. Neighbouring windows mostly share theirs: about one row for nine windows is shuffled.
   Windows whose anchor occurs once in the corpus cannot repeat.
2. Windows. For the ranges that are left, every window's own hash is counted over the corpus; windows with
   a count of two or more repeat, and all words they cover are removed.

Counts are aggregated before the shuffle, so a passage that a third of all documents share is one partial
count a task. Hashes have 64 bits.

Cases: null and empty texts have no words; texts of fewer than WINDOW words are kept; a window that occurs
twice in one document, or in a repeated row, repeats; rows of equal id and text get equal results; documents
of any length are worked off whole. Columns besides the id and the text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import arrow_udf, attach, row_key, stage, table
from quillstack.llm.hashing import U, windows, word_hashes

WINDOW = 35
ANCHOR = 18
REACH = WINDOW - ANCHOR + 1  # anchors in a window


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every run of `size` values, by doubling."""
    least, have = values, 1
    while have * 2 <= size:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = size - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchor_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, first window, number of windows, and how many occurrences
    it stands for (2 if the run itself may hold a repeat, else 1)."""
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams = windows(words, ANCHOR)
    least = sliding_least(grams, REACH)
    equal = np.zeros(len(least), np.int8)
    for i in range(REACH):
        equal += grams[i : i + len(least)] == least
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.append(first, len(least)))
    twice = (np.maximum.reduceat(equal, first) > 1) | (count > REACH)
    return least[first].view(np.int64), first, count, 1 + twice.astype(np.int64)


def ranges_to_bytes(start: np.ndarray, end: np.ndarray) -> bytes:
    """Sorted, merged half-open ranges as pairs of 32-bit integers."""
    if not len(start):
        return b""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return np.stack((start[at], end[np.append(at[1:], len(end)) - 1]), axis=1).astype(np.int32).tobytes()


def ranges_of(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.int32).reshape(-1, 2)


def anchors_udf():
    kind = pa.list_(pa.struct([("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("weight", pa.int32())]))

    @arrow_udf("array<struct<h:bigint,start:int,n:int,weight:int>>")
    def anchors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [anchor_runs(word_hashes(t or b"")) for t in batch.to_pylist()]
            ends = np.cumsum([0, *(len(f[0]) for f in found)], dtype=np.int32)
            columns = [np.concatenate([f[c] for f in found]) for c in range(4)]
            fields = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
            yield pa.ListArray.from_arrays(pa.array(ends), fields)

    return anchors


def merged_udf():
    """starts and lengths -> merged ranges."""

    @arrow_udf("binary")
    def merged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for starts, sizes in batches:
            rows = [(s.values.to_numpy(), n.values.to_numpy()) for s, n in zip(starts, sizes, strict=True)]
            yield pa.array([ranges_to_bytes(s, s + n) for s, n in rows], pa.binary())

    return merged


def covered_udf():
    """Starts of repeated windows -> merged ranges of the words they cover."""

    @arrow_udf("binary")
    def covered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for starts in batches:
            yield pa.array([ranges_to_bytes(s.values.to_numpy(), s.values.to_numpy() + WINDOW) for s in starts], pa.binary())

    return covered


def windows_udf():
    """text and ranges of windows -> hash and place of each of these windows."""
    kind = pa.struct([("h", pa.int64()), ("at", pa.int32())])

    @arrow_udf("array<struct<h:bigint,at:int>>")
    def hashed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            hashes, places = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            sizes = [0]
            for text, wanted in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
                words, n = word_hashes(text or b""), 0
                for start, end in ranges_of(wanted):
                    hashes.append(windows(words[start : end + WINDOW - 1], WINDOW))
                    places.append(np.arange(start, end))
                    n += end - start
                sizes.append(n)
            fields = pa.StructArray.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places), pa.int32())], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), fields)

    return hashed


def removal_udf():
    """text and ranges of words -> struct<n_words, n_removed, kept>."""

    @arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def removed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            n, gone, kept = [], [], []
            for text, drop in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
                words = (text or b"").split()
                n.append(len(words))
                cut = ranges_of(drop)
                for start, end in cut[::-1]:
                    del words[start:end]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"])

    return removed


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """docs (_k, data) -> (_k, ranges): merged ranges of the words that repeated windows cover."""
    runs = docs.select("_k", F.explode(anchors_udf()(F.col("data"))).alias("r")).select("_k", "r.*")
    shared = runs.groupBy("h").agg(F.sum("weight").alias("weight")).where("weight > 1").select("h")
    lists = runs.select("_k", "h", "start", "n").join(shared, "h").groupBy("_k").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
    wanted = stage(lists.select("_k", merged_udf()(F.col("starts"), F.col("sizes")).alias("wanted")))
    # rows that repeat are kept apart here: each is an occurrence of its own
    hashed = attach(docs, wanted, "_k", ["wanted"], "inner").select("_k", F.explode(windows_udf()(F.col("data"), F.col("wanted"))).alias("w")).select("_k", "w.*")
    again = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    starts = hashed.join(again, "h").groupBy("_k").agg(F.collect_list("at").alias("at"))
    return stage(starts.select("_k", covered_udf()(F.col("at")).alias("ranges")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept (the words that are left, joined by a space)."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("data"), row_key(doc_id, text).alias("_k"))
    ranges = repeated_ranges(keyed.select("_k", "data"))
    done = attach(keyed, ranges, "_k", ["ranges"]).select("doc_id", removal_udf()(F.col("data"), F.col("ranges")).alias("r"))
    return done.select("doc_id", "r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
