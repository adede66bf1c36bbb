"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, identifier cues, and the digit pairs
with which numbers begin. A small deterministic parser then expands each anchor to its boundaries and
validates what it found. Every parser reads a stretch of text once, so whole texts of any length take
linear time.

Base kinds (email, ip, card, phone) are exactly the leftmost non-overlapping matches of their patterns;
a candidate that fails its validation is dropped and not tried again at another boundary. Further kinds:
account (an identifier after a cue such as `token =`) and address (a URL with user information or a
numeric host).

Cases: a null or empty text has no spans; offsets count code points, the end is exclusive; spans of
different kinds may overlap; repeated rows get equal results. Other columns are passed on; a column spans of the caller's
is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import arrow_udf, table

KINDS = ("email", "ip", "card", "phone", "account", "address")
BASE = KINDS[:4]
CUES = ("token", "api_key", "apikey", "secret", "password", "passwd", "iban", "account", "acct", "ssn", "passport")
DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPED_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NAMED = r"(?=[\"' \t:=#])[\"']?(?:[ \t]{1,2}(?:number|no\.?|num\.?|nr\.?|id|code|key)(?![A-Za-z0-9_]))?[ \t]{0,2}"
ASSIGNED = re.compile(NAMED + r"((?:[:=#]|is(?=[ \t]))?)[ \t]{0,2}[\"']?([A-Za-z0-9_-]{8,})", re.IGNORECASE)
#: An IBAN in one run or in groups; its checksum tells where it ends.
GROUPED_IBAN = re.compile(NAMED + r"(?:[:=#]|is(?=[ \t]))?[ \t]{0,2}[\"']?([A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30})", re.IGNORECASE)
#: Cues whose values need no digits, if a sign is set between: a password may be a word.
SECRETS = ("token", "api_key", "apikey", "secret", "password", "passwd")
AUTHORITY = re.compile(r"(?:([^\s/?#@\"'<>]++)@)?([A-Za-z0-9.-]+)(?::[0-9]{1,5})?")
FOUR_NUMBERS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


@lru_cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    words: dict[str, str] = {"@": "at", "://": "scheme"}
    for a in DIGITS:
        words[f"+{a}"] = "plus"
        for b in DIGITS:
            words |= {f"{a}{b}": "digits", f"{a} {b}": "digits", f"{a}-{b}": "digits", f"{a}.{b}": "dotted"}
    for cue in CUES:
        words[cue] = "cue"
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_end(value: str) -> int:
    """Where the longest valid IBAN that begins a run ends; 0 if none does."""
    for end in range(len(value), 14, -1):
        code = re.sub("[ -]", "", value[:end])
        if len(code) >= 15 and not value[end : end + 1].isalnum() and value[end - 1].isalnum() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
    return 0


class Parsers:
    """Local parsers of one text; `past` holds how far each kind has read."""

    def __init__(self, text: str):
        self.text = text
        self.past = dict.fromkeys(KINDS, 0)
        self.spans: list[Span] = []

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((start, KINDS.index(kind), end))

    def at(self, i: int) -> None:
        text, start = self.text, i
        while start > self.past["email"] and text[start - 1] in LOCAL:
            start -= 1
        if start < i and (domain := DOTTED_LABELS.match(text, i + 1)):
            self.add("email", start, domain.end())
            self.past["email"] = domain.end()

    def dotted(self, i: int) -> None:
        """A chain of numbers is read off in fours."""
        if i < self.past["ip"]:
            return
        text = self.text
        while i > 0 and text[i - 1] in DIGITS:
            i -= 1
        chain = NUMBER_CHAIN.match(text, i)
        self.past["ip"] = chain.end()
        ends, starts, at = [], [], i
        for part in chain[0].split("."):
            starts.append(at)
            ends.append(at + len(part))
            at += len(part) + 1
        for k in range(0, len(starts) - 3, 4):
            parts = [text[starts[j] : ends[j]].lstrip("0") for j in range(k, k + 4)]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                self.add("ip", starts[k], ends[k + 3])

    def digits(self, i: int) -> None:
        if i < self.past["card"]:
            return
        run = GROUPED_DIGITS.match(self.text, i)
        self.past["card"] = run.end()
        digits = run[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            self.add("card", i, run.end())

    def plus(self, i: int) -> None:
        if i >= self.past["phone"] and (run := DIALLED.match(self.text, i)):
            self.past["phone"] = run.end()
            if 9 <= sum(c in DIGITS for c in run[0]) <= 15:
                self.add("phone", i, run.end())

    def cue(self, i: int, size: int) -> None:
        text = self.text
        if i < self.past["account"] or i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            return
        if text[i : i + size].lower() == "iban" and (value := GROUPED_IBAN.match(text, i + size)) and (end := iban_end(value[1])):
            self.add("account", value.start(1), value.start(1) + end)
            self.past["account"] = value.start(1) + end
            return
        value = ASSIGNED.match(text, i + size)
        if not value:
            return
        bare = value[1] in (":", "=") and text[i : i + size].lower() in SECRETS
        if bare or sum(c in DIGITS for c in value[2]) >= 3:
            self.add("account", value.start(2), value.end(2))
            self.past["account"] = value.end(2)

    def scheme(self, i: int) -> None:
        text, start = self.text, i
        while start > max(0, i - 12) and text[start - 1].isascii() and text[start - 1].isalpha():
            start -= 1
        if start == i or start < self.past["address"]:
            return
        host = AUTHORITY.match(text, i + 3)
        if host and (host[1] or FOUR_NUMBERS.fullmatch(host[2])):
            self.add("address", start, host.end())
            self.past["address"] = host.end()


def lowered(text: str) -> str:
    """Lower case with the same offsets."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def find(text: str | None) -> list[Span]:
    """All spans of a whole text, by start, then kind."""
    if not text:
        return []
    parsers = Parsers(text)
    for last, (kind, size) in automaton().iter(lowered(text)):
        first = last - size + 1
        if kind == "cue":
            parsers.cue(first, size)
        else:
            getattr(parsers, kind)(first)
    return sorted(parsers.spans)


def finder():
    """A function of a text column to its spans."""

    @arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            yield pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] for t in batch.to_pylist()], kind)

    return spans


def find_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column spans: array<struct<kind, start, end>> added, never null."""
    return df.withColumn("spans", finder()(F.col(text)))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(*kinds: str) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(of_kinds(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(listed(of_kinds(*BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
