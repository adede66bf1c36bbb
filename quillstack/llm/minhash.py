"""Near-duplicate documents by MinHash, odd sketches and exact verification.

Each text becomes the set of its distinct five-word shingles. Texts with equal sets form one class; per
class one signature of SAMPLES minima is kept, cut into BANDS keys of ROWS minima each, and folded into an
odd sketch: a bitmap in which every sampled (place, minimum) flips one bit. The population count of two
sketches' XOR estimates how many minima differ, and so the similarity. Classes that share a band key are
candidates; those whose sketches rule out the threshold by a wide margin go; the rest are compared on their
full sets. A pair of similarity 0.75 shares no band key with a probability of about 5 in a million.

Large groups of near copies are linked through a hub of each bucket, and what the hubs leave open through the
rarest shingles (see components), so no bucket is expanded into all its pairs. Everything is keyed by the shingle set, so document ids may repeat or be null.

Cases: a text without words, or null, has no shingles, is linked with nothing and is its own component;
fewer than five words form one shingle; equal texts are one class and so always linked; of a component the
least id is kept (all rows that carry it); a row with a null id belongs to its text's component and is kept
only if no row there has an id. Columns besides the id and the text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import arrow_udf, attach, row_key, scratch, stage, table
from quillstack.llm.components import link_buckets
from quillstack.llm.hashing import U, mix, sequence_hash, windows, word_hashes

SHINGLE = 5
SAMPLES, BANDS, ROWS = 128, 32, 4
SKETCH_BITS = 256
#: Similarity of at least PARTS in WHOLE.
PARTS, WHOLE = 75, 100
#: An odd sketch's estimate is trusted to be off by less than this: at similarity 0.75 it is 6 deviations.
SLACK = 0.3
#: Shingles that are hashed at a time, by all samples.
PIECE = 256
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=U)) | U(1)
_SALTS = mix(np.arange(1001, 1001 + SAMPLES, dtype=U))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text in UTF-8, ASCII letters lower-cased."""
    words = word_hashes((text or b"").lower())
    if not len(words):
        return words
    if len(words) < SHINGLE:
        return np.array([sequence_hash(words)], U)
    return np.unique(windows(words, SHINGLE))


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of a whole set, signed."""
    total = mix(np.array([mix(shingles ^ U(0x5DEECE66D)).sum(dtype=U) + U(len(shingles))], U))
    return int(total.view(np.int64)[0])


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(U).max, U)
    for at in range(0, len(shingles), PIECE):
        hashed = shingles[at : at + PIECE, None] ^ _SALTS
        hashed *= _FACTORS
        np.minimum(least, hashed.min(axis=0), out=least)
    return mix(least)


def band_keys(least: np.ndarray) -> np.ndarray:
    grouped = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=U)
    for i in range(ROWS):
        h = mix(h ^ grouped[:, i])
    return h.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits in 64-bit words: the parity of how many samples hash to each."""
    bits = mix(least + np.arange(SAMPLES, dtype=U) * U(0x9E3779B97F4A7C15)) % U(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def features():
    """text (binary) -> struct<n, set_key, sketch, bands>."""
    kind = pa.struct([("n", pa.int64()), ("set_key", pa.int64()), ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    @arrow_udf("struct<n:bigint,set_key:bigint,sketch:array<bigint>,bands:array<bigint>>")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, keys, sketches, bands = [], [], [], []
            for text in batch.to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                keys.append(set_key(s))
                least = signature(s) if len(s) else None
                sketches.append(odd_sketch(least) if len(s) else None)
                bands.append(band_keys(least) if len(s) else None)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], fields=list(kind))

    return extract


def full_sets():
    """text (binary) -> struct<set_key, shingles: sorted 64-bit hashes>."""

    @arrow_udf("struct<set_key:bigint,shingles:array<bigint>>")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate([np.zeros(0, U), *sets]).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["set_key", "shingles"])

    return extract


def _similar_sketches(a: str, b: str) -> Column:
    """Whether sizes and odd sketches leave the threshold open."""
    differing = F.aggregate(F.zip_with(f"{a}.odd", f"{b}.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    inner = F.greatest(1 - 2 * differing / SKETCH_BITS, F.lit(1e-3))
    estimate = 1 + F.lit(SKETCH_BITS / (4 * SAMPLES)) * F.log(inner)
    sizes = (F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (F.least(*sizes) * WHOLE >= F.greatest(*sizes) * PARTS) & (estimate >= PARTS / WHOLE - SLACK)


class _Sets:
    """Shingle sets as link_buckets sees them; ids are set keys."""

    rounds, neighbours = 0, 0

    def __init__(self, docs: DataFrame, doc_id: str, text: str, classes: DataFrame):
        self.docs, self.doc_id, self.text, self.classes = docs, doc_id, text, classes

    def near(self, a: str, b: str) -> Column:
        return _similar_sketches(a, b)

    def prepare(self, ids: DataFrame) -> None:
        wanted = stage(self.classes.select("set_key", "place").join(ids.withColumnRenamed("id", "set_key"), "set_key"))
        texts = stage(attach(self.docs.select(row_key(f"`{self.doc_id}`", f"`{self.text}`").alias("place"), F.col(f"`{self.text}`").cast("binary").alias("data")), stage(wanted.select("place").distinct()), "place", [], "left_semi"))
        sets = texts.select(full_sets()(F.col("data")).alias("s")).select("s.*")
        self.sets = stage(sets.dropDuplicates(["set_key"]).withColumnRenamed("set_key", "id"))
        self.sketches = self.classes.select(F.col("set_key").alias("id"), F.struct("n", F.col("sketch").alias("odd")).alias("sketch"))

    def verify(self, pairs: DataFrame) -> DataFrame:
        both = pairs
        for end, name in (("a", "x"), ("b", "y")):
            both = both.join(self.sets.select(F.col("id").alias(end), F.col("shingles").alias(name)), end)
        counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("size"))
        return counted.where(F.col("common") * WHOLE >= (F.col("size") - F.col("common")) * PARTS)

    open = near

    def tokens(self, ids: DataFrame) -> DataFrame:
        n = F.size("shingles")
        return self.sets.join(ids, "id").select("id", n.alias("n"), n.alias("size"), F.explode("shingles").alias("token"))

    def prefix(self, n: Column, known: Column, size: Column) -> Column:
        """Of n shingles, ceil(0.75 n) are shared with whatever a set is linked with."""
        return known - F.ceil(n * PARTS / WHOLE) + 1

    def shared(self, n: tuple[Column, Column], size: tuple[Column, Column]) -> Column:
        return F.ceil((n[0] + n[1]) * PARTS / (PARTS + WHOLE))


def find_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Returns (rows, classes): rows (_k, doc_id, n, set_key), one for each document; classes (set_key,
    component_id, group), one for each shingle set, with the least id and the least set of its component."""
    with scratch():
        docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        rows = stage(docs.select(row_key("doc_id", "text").alias("_k"), "doc_id", features()(F.col("text").cast("binary")).alias("f")).select("_k", "doc_id", "f.*"), keep=True)
        filled = rows.where("n > 0")
        classes = stage(filled.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("_k").alias("place"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
        members = classes.select(F.explode("bands").alias("bucket"), F.col("set_key").alias("id"))
        labels = link_buckets(members, _Sets(docs, "doc_id", "text", classes)).labels
        labelled = classes.select("set_key", "least").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
        least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
        return rows.select("_k", "doc_id", "n", "set_key"), stage(labelled.join(least, "label").select("set_key", "component_id", F.col("label").alias("group")), keep=True)


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    rows, classes = find_near_duplicates(docs, doc_id, text)
    joined = rows.join(classes, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that are near duplicates of one that stays: of each component the one of
    the least id, then row key. Texts without words all stay; rows of one id and one text are one document."""
    rows, classes = find_near_duplicates(docs, doc_id, text)
    placed = rows.where("n > 0").join(classes, "set_key").select("_k", "doc_id", "set_key", "group")
    first = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k"))["_k"].alias("first"))
    gone = stage(placed.join(first, "group").where("_k <> first").select("_k").distinct())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("_row"), row_key(f"`{doc_id}`", f"`{text}`").alias("_k"))
    return attach(keyed, gone, "_k", [], "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
