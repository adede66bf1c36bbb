"""Byte-level BPE encoding and decoding.

A vocabulary file gives merge ranks. Each pre-token becomes a doubly linked list of byte symbols; a
priority queue of (rank, position) merges the best adjacent pair until none is left, skipping entries
whose symbols have changed since. Decoding concatenates vocabulary strings and reads them as UTF-8.

Cases: a null or empty text has no tokens and decodes to the empty string; special-token strings in a
text become their ids, as the tokenizers library has it; texts of any length are encoded whole; repeated
rows give equal results. An id outside the vocabulary cannot be decoded and raises KeyError.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import Memo, arrow_udf, table

#: Chunks and pre-tokens whose ids are remembered; longer ones are not worth a place.
CACHE, CACHED_CHARS = 150_000, 64
#: Bits of an id, and of a place in a pre-token.
WIDTH = 40
PLACE = (1 << WIDTH) - 1
#: Rows and ids that are worked on at a time.
ROWS, PIECE = 500, 1 << 20
# White_Space, and the byte alphabet's printable ranges.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers of Unicode 17.0 that 16.0 lacks: the tokenizers library takes them for neither.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 "
    "16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
#: A chunk is a run without white space and the single space before it: the splitting pattern never joins two chunks.
CHUNKS = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
NEWER_SET = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in NEWER.split())
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def splitter(letters: str, numbers: str, others: str) -> regex.Pattern:
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?{others}+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


@lru_cache
def splitters() -> tuple[re.Pattern, regex.Pattern, regex.Pattern]:
    """What finds newer letters; the splitting pattern without regard to them, and with."""
    plain = splitter(r"\p{L}", r"\p{N}", rf"[^{SPACES}\p{{L}}\p{{N}}]")
    letters, numbers = (rf"[\p{{{x}}}--[{NEWER_SET}]]" for x in "LN")
    return re.compile(f"[{NEWER_SET}]"), plain, splitter(letters, numbers, rf"(?:[^{SPACES}\p{{L}}\p{{N}}]|[{NEWER_SET}])")


@lru_cache
def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary strings."""
    plain = {b for r in PRINTABLE for b in r}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks and vocabulary bytes from a tokenizer file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normalizer or prefix space")
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.first = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << WIDTH | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.newer, self.split, self.split_newer = splitters()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = Memo(self._chunk, CACHE)
        size = max(self.bytes) + 1
        self.lengths = np.array([len(self.bytes.get(i, b"")) for i in range(size)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), np.uint8)

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token's bytes. A queue entry is a rank and, in its low bits, the place of the left symbol."""
        first = self.first
        ids = [first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, made = self.ranks.get, self.made
        queue = [rank << WIDTH | i for i, (a, b) in enumerate(pairwise(ids)) if (rank := rank_of(a << WIDTH | b)) is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i, rank = entry & PLACE, entry >> WIDTH
            a, j = ids[i], after[i]
            if a < 0 or j >= n or rank_of(a << WIDTH | ids[j]) != rank:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = new, _ = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(new << WIDTH | ids[k])) is not None:
                    heappush(queue, rank << WIDTH | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(ids[h] << WIDTH | new)) is not None:
                heappush(queue, rank << WIDTH | h)
        return [x for x in ids if x >= 0]

    def _packed(self, token: str) -> bytes:
        return array("i", self.merge(token.encode())).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Most chunks are one pre-token. The pre-tokens of others are remembered as the chunks that they would be."""
        split = self.split if chunk.isascii() or not self.newer.search(chunk) else self.split_newer
        found = split.findall(chunk)
        if len(found) == 1:
            return self._packed(chunk)
        return b"".join([self.chunks[t] if len(t) <= CACHED_CHARS else self._packed(t) for t in found])

    def _plain(self, text: str) -> bytes:
        chunks = self.chunks
        return b"".join([chunks[c] if len(c) <= CACHED_CHARS else self._chunk(c) for c in CHUNKS.findall(text)])

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text."""
        if not text:
            return np.zeros(0, np.int32)
        if self.split_special is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), np.int32)
        parts = self.split_special.split(text)
        return np.frombuffer(b"".join(np.int32(self.special[p]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; bytes that are not UTF-8 become U+FFFD."""
        out = []
        for at in range(0, len(ids), PIECE):
            piece = ids[at : at + PIECE]
            if len(piece) and (piece.min() < 0 or piece.max() >= len(self.lengths) or not self.lengths[piece].all()):
                raise KeyError("an id outside the vocabulary")
            size = self.lengths[piece]
            shift = self.starts[piece] - (np.cumsum(size) - size)
            out.append(self.blob[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(content: str) -> Vocabulary:
    return Vocabulary(content)


def as_lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))


def slices(batch: pa.Array) -> Iterator[pa.Array]:
    """A batch in parts of few rows, so that what a worker holds stays small."""
    for at in range(0, len(batch), ROWS):
        yield batch.slice(at, ROWS)


def encoder(spark: SparkSession, content: str):
    """A function of a text column to its token ids (array<int>; never null)."""
    shared = spark.sparkContext.broadcast(content)

    @arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _loaded(shared.value)
        for batch in batches:
            yield pa.concat_arrays([as_lists([vocabulary.encode(t) for t in part.to_pylist()]) for part in slices(batch)])

    return ids


def decoder(spark: SparkSession, content: str):
    """A function of a column of token ids to the text they stand for (null ids: empty)."""
    shared = spark.sparkContext.broadcast(content)

    @arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _loaded(shared.value)
        for batch in batches:
            yield pa.array([vocabulary.decode(np.zeros(0, np.int32) if x.as_py() is None else x.values.to_numpy(zero_copy_only=False)) for x in batch], pa.string())

    return text


def codec(spark: SparkSession, content: str):
    """A function of a text column to struct<ids, decoded>: encoded, and decoded from these ids again."""
    shared = spark.sparkContext.broadcast(content)

    @arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _loaded(shared.value)
        for batch in batches:
            parts = []
            for part in slices(batch):
                found = [vocabulary.encode(t) for t in part.to_pylist()]
                parts.append(pa.StructArray.from_arrays([as_lists(found), pa.array([vocabulary.decode(x) for x in found], pa.string())], names=["ids", "decoded"]))
            yield pa.concat_arrays(parts)

    return both


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with columns ids (array<int>) and decoded (string); the caller's of these names are replaced, all others kept."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        content = f.read()
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    done = df.select(row, codec(df.sparkSession, content)(F.col(f"`{text}`")).alias("made"))
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in ("ids", "decoded")], "made.ids", "made.decoded")


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
