"""Benchmark decontamination by SimHash windows.

Every benchmark item and every window of as many words, moved word by word over a document, gets a 64-bit
SimHash of its words. Items are found by multi-index blocks: fingerprints within RADIUS bits agree exactly
in at least one of RADIUS + 1 blocks, so a table of block values to items misses none of them. Candidates
are then compared exactly, by the weighted similarity of their five-word shingles (a shingle weighs as many
letters as it has, and counts as often as it occurs), and count from THRESHOLD on.

Windows are only moved where they can matter: a pair of similarity above 0 has a shingle in common, so
windows that hold no shingle of an item of their length are passed over; this loses nothing. A document of
fewer words than an item is compared with it as a whole, without fingerprints.

Words are lower-cased runs of letters, digits and underscores. The benchmark is a list of bounded size,
MAX_ITEM_BYTES at most, sent to all executors; a longer one is worked off in parts of that size.

Cases: null and empty texts match nothing, neither do items without words; items of fewer than five words
are one shingle; items that repeat are reported each; a window is reported for its best place only;
repeated rows give equal results; documents of any length are read whole. Other columns are passed on; a column matches
of the caller's is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import arrow_udf, table
from quillstack.llm.hashing import U, mix, sequence_hash, windows

SHINGLE = 5
RADIUS, THRESHOLD = 15, 0.75
BLOCK_BITS = 64 // (RADIUS + 1)
MAX_ITEM_BYTES = 8 << 20
WORDS = re.compile(r"\w+")
_BITS = np.arange(64, dtype=U)


def word_codes(words: list[str]) -> np.ndarray:
    return mix(np.fromiter((crc32(w.encode()) for w in words), U, len(words)) + np.fromiter(map(len, words), U, len(words)) * U(1 << 32))


def votes(codes: np.ndarray) -> np.ndarray:
    """How many words before each place have each bit: a prefix sum of shape (words + 1, 64)."""
    bits = ((codes[:, None] >> _BITS) & U(1)).astype(np.int32)
    return np.vstack((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))


def fingerprints(prefix: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of the windows of `size` words that begin at `starts`."""
    more = 2 * (prefix[starts + size] - prefix[starts]) > size
    return (more.astype(U) << _BITS).sum(axis=1, dtype=U)


def shingles(codes: np.ndarray) -> np.ndarray:
    if len(codes) < SHINGLE:
        return np.array([sequence_hash(codes)], U) if len(codes) else np.zeros(0, U)
    return windows(codes, SHINGLE)


def weighted(words: list[str], codes: np.ndarray) -> Counter:
    """Shingles with their weights."""
    reach = min(SHINGLE, len(words))
    size = [len(w) for w in words]
    out: Counter = Counter()
    for i, h in enumerate(shingles(codes).tolist()):
        out[h] += sum(size[i : i + reach])
    return out


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(w, b[h]) for h, w in a.items() if h in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


class Index:
    """Items by length, by shingle, and by the values of their fingerprints' blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.weights: dict[int, Counter] = {}
        self.prints: dict[int, int] = {}
        self.ids: dict[int, int] = {}
        self.lengths: dict[int, list[int]] = defaultdict(list)
        of_shingle: dict[int, set[int]] = defaultdict(set)
        for k, (item_id, text) in enumerate(items):
            words = WORDS.findall((text or "").lower())
            if not words:
                continue
            codes = word_codes(words)
            self.ids[k], self.weights[k] = item_id, weighted(words, codes)
            self.prints[k] = int(fingerprints(votes(codes), np.zeros(1, np.int64), len(words))[0])
            self.lengths[len(words)].append(k)
            for h in self.weights[k]:
                of_shingle[h].add(len(words))
        self.blocks = {n: [defaultdict(list) for _ in range(RADIUS + 1)] for n in self.lengths}
        for n, held in self.lengths.items():
            for k in held:
                for b, place in enumerate(self.blocks[n]):
                    place[self.prints[k] >> (b * BLOCK_BITS) & ((1 << BLOCK_BITS) - 1)].append(k)
        self.long = [n for n in self.lengths if n >= SHINGLE]
        self.short = [n for n in self.lengths if n < SHINGLE]
        self.known = np.array(sorted(h for h, sizes in of_shingle.items() if max(sizes) >= SHINGLE), U)
        self.longest = max(self.lengths, default=0)
        self.sizes = {h: sorted(s) for h, s in of_shingle.items()}

    def _starts(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """By item length: the windows that hold a shingle of such an item."""
        wanted: dict[int, list[int]] = defaultdict(list)
        grams = windows(codes, SHINGLE) if len(self.known) else np.zeros(0, U)
        if len(grams):
            at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
            for i in np.flatnonzero(self.known[at] == grams).tolist():
                for n in self.sizes[int(grams[i])]:
                    if n >= SHINGLE:
                        wanted[n].append(i)
        out = {}
        for n, places in wanted.items():
            first = np.maximum(np.array(places) - (n - SHINGLE), 0)
            last = np.minimum(np.array(places), len(codes) - n)
            hit = np.zeros(max(len(codes) - n + 2, 1), np.int64)
            fit = first <= last
            np.add.at(hit, first[fit], 1)
            np.add.at(hit, last[fit] + 1, -1)
            out[n] = np.flatnonzero(np.cumsum(hit)[: max(len(codes) - n + 1, 0)] > 0)
        for n in self.short:
            if len(codes) >= n:
                own = set(self.lengths[n])
                keys = {h for k in own for h in self.weights[k]}
                starts = np.arange(len(codes) - n + 1)
                out[n] = np.array([i for i in starts if sequence_hash(codes[i : i + n]) in keys], np.int64)
        return out

    def find(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item id, first word, end, similarity) of each item that a text holds, at its best place."""
        words = WORDS.findall((text or "").lower())
        if not words or not self.ids:
            return []
        codes = word_codes(words)
        best: dict[int, tuple[float, int, int]] = {}
        for n, starts in self._starts(codes).items():
            if not len(starts):
                continue
            for at in range(0, len(starts), 4096):
                part = starts[at : at + 4096]
                low, high = int(part[0]), int(part[-1]) + n
                pieces = self._prints(codes, part, n, low, high)
                for start, print_ in zip(part.tolist(), pieces.tolist(), strict=True):
                    self._verify(words, codes, start, n, print_, best)
        self._whole(words, codes, best)
        return sorted((self.ids[k], start, end, round(s, 6)) for k, (s, start, end) in best.items())

    def _whole(self, words: list[str], codes: np.ndarray, best: dict) -> None:
        """Compare a document with the items that have more words than it and a shingle in common."""
        if len(codes) < SHINGLE or len(codes) >= self.longest:
            return
        grams = windows(codes, SHINGLE)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        held = {k for h in grams[self.known[at] == grams].tolist() for n in self.sizes[h] if n > len(codes) for k in self.lengths[n]}
        if held:
            own = weighted(words, codes)
            for k in held:
                s = similarity(own, self.weights[k])
                if s >= THRESHOLD:
                    best[k] = (s, 0, len(codes))

    @staticmethod
    def _prints(codes: np.ndarray, starts: np.ndarray, n: int, low: int, high: int) -> np.ndarray:
        if high - low <= 8 * (len(starts) + n):
            return fingerprints(votes(codes[low:high]), starts - low, n)
        return np.concatenate([fingerprints(votes(codes[s : s + n]), np.zeros(1, np.int64), n) for s in starts])

    def _verify(self, words, codes, start: int, n: int, print_: int, best: dict) -> None:
        mask = (1 << BLOCK_BITS) - 1
        near = {k for b, place in enumerate(self.blocks[n]) for k in place.get(print_ >> (b * BLOCK_BITS) & mask, ()) if (self.prints[k] ^ print_).bit_count() <= RADIUS}
        if near:
            own = weighted(words[start : start + n], codes[start : start + n])
            for k in near:
                s = similarity(own, self.weights[k])
                if s >= THRESHOLD and s > best.get(k, (0.0, 0, 0))[0]:
                    best[k] = (s, start, start + n)


def matcher(spark: SparkSession, items: list[tuple[int, str]]):
    """A function of a text column to array<struct<item_id, start, end, similarity>>."""
    shared = spark.sparkContext.broadcast(Index(items))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("similarity", pa.float64())]))

    @arrow_udf("array<struct<item_id:bigint,start:int,end:int,similarity:double>>")
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        for batch in batches:
            yield pa.array([[dict(zip(("item_id", "start", "end", "similarity"), m, strict=True)) for m in index.find(t)] for t in batch.to_pylist()], kind)

    return match


def item_parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in parts of at most MAX_ITEM_BYTES."""
    part, size = [], 0
    for item_id, text in benchmark.where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if part and size + len(text) * 4 > MAX_ITEM_BYTES:
            yield part
            part, size = [], 0
        part.append((item_id, text))
        size += len(text) * 4
    yield part


def find_benchmark_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column matches: array<struct<item_id, start, end, similarity>> added, never null."""
    found = F.array().cast("array<struct<item_id:bigint,start:int,end:int,similarity:double>>")
    for items in item_parts(benchmark.select("item_id", "text")):
        found = F.concat(found, matcher(docs.sparkSession, items)(F.col(text)))
    return docs.withColumn("matches", found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_benchmark_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", *[m[c].cast("string") for c in ("item_id", "start", "end")])), ",")
    return docs.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_matches"), listed.alias("matches"))
