"""Language identification by interpolated Kneser-Ney character language models.

For each language a model of orders 1 to ORDER is estimated from the words of a bounded sample of its
documents. All models live together in sorted arrays of n-gram hashes, one column a language, searched
by bisection. A text gets the language of the lowest cross-entropy per character; it is rejected if that
is nearer to text of shuffled letters than to text of the language (the limit is calibrated on held-back
documents of the sample, see _limit).

Words are maximal runs of letters, lower-cased, with a boundary before and after; n-grams stay inside.

Cases: null, empty and letterless texts are `und` with score 0 and are rejected; ties between languages
go to the first in alphabetical order; a text of any length is scored whole; repeated rows get equal
results; without any training rows every text is `und`. Other columns play no part and are passed on; a column lang_id
of the caller's is replaced. Null ids are not held out. Labels that repeat, and rows that repeat, count as often as they are there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import arrow_udf, bound, draw, stage, table
from quillstack.llm.hashing import U, mix

ORDER = 5
#: About so many documents of each language train the models; every fifth of them only calibrates.
SAMPLE_DOCS = 600
#: Tokens that a worker remembers, up to what length, and the texts it works on at a time.
CACHE, CACHED_CHARS, ROWS = 150_000, 48, 200
#: Of dirty language columns only so many values are learned, the most frequent ones.
MOST_LANGUAGES = 400
UND = "und"
#: Rejection: the share of held-back documents, and of shuffled ones, that may lie beyond the points the limit is set between.
TAIL = 0.01
LETTERS = regex.compile(r"\p{L}+")
_BASE = U(0x9E3779B97F4A7C15)


def _ngrams(codes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each place, where the word reaches back that far, and those places."""
    ends = np.flatnonzero(at >= n - 1)
    h = np.zeros(len(ends), U)
    for i in range(n - 1, -1, -1):
        h = h * _BASE + codes[ends - i]
    return mix(h + U(n)), ends


def _longest(codes: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the longest n-grams, of up to ORDER characters, that end at these places and stay in their words."""
    h = np.zeros(len(places), U)
    back = at[places]
    for i in range(ORDER - 1, -1, -1):
        h = h * _BASE + np.where(back >= i, codes[np.maximum(places - i, 0)], U(0))
    return mix(h)


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each between two boundaries; places within words; starts of words."""
    joined = "".join(f" {w} " for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(U)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(size) - size
    return codes, np.arange(len(codes)) - np.repeat(starts, size), starts


@dataclass
class Models:
    """Of each order: sorted n-gram hashes with discounted probabilities, sorted context hashes with back-off weights."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    whole: tuple[np.ndarray, np.ndarray]
    limits: np.ndarray

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of every place but the words' first boundaries: the natural logarithm of its character's probability, by language."""
        places = np.flatnonzero(at > 0)
        out = np.zeros((len(codes), len(self.languages)))
        known, rows = _search(self.whole[0], _longest(codes, at, places))
        out[places[known]] = self.whole[1][rows[known]]
        left = places[~known]
        if len(left):
            out[left] = self._interpolated(codes, at, left)
        return out

    def _interpolated(self, codes: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        p = np.full((len(places), len(self.languages)), 1e-5)
        for n in range(1, ORDER + 1):
            fit = np.flatnonzero(at[places] >= n - 1)
            ends = places[fit]
            h, c = np.zeros(len(ends), U), np.zeros(len(ends), U)
            for i in range(n - 1, -1, -1):
                c = h
                h = h * _BASE + codes[ends - i]
            seen, rows = _search(self.grams[n - 1][0], mix(h + U(n)))
            found, back = _search(self.contexts[n - 1][0], mix(c + U(n - 1)))
            weight = np.ones((len(ends), p.shape[1]))
            weight[found] = self.contexts[n - 1][1][back[found]]
            own = np.zeros_like(weight)
            own[seen] = self.grams[n - 1][1][rows[seen]]
            p[fit] = own + weight * p[fit]
        return np.log(p)

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word by language."""
        codes, at, starts = _laid_out(words)
        return np.add.reduceat(self.log_probabilities(codes, at).astype(np.float64), starts, axis=0)


def _search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    rows = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[rows] == wanted, rows


def _order_table(kinds: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted array of the hashes of all languages, and a row of values for each."""
    keys = np.unique(np.concatenate([np.zeros(0, U), *(k for k, _ in kinds)]))
    values = np.zeros((len(keys), len(kinds)))
    for column, (k, v) in enumerate(kinds):
        values[np.searchsorted(keys, k), column] = v
    return keys, values


def _kneser_ney(words: list[str], weights: np.ndarray) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray]:
    """One language's discounted probabilities and back-off weights, order by order."""
    codes, at, starts = _laid_out(words)
    weight = np.repeat(weights, np.diff(np.append(starts, len(codes))))
    grams, contexts = [], []
    for n in range(1, ORDER + 1):
        h, ends = _ngrams(codes, at, n)
        if n == 1:
            h, ends = h[at[ends] > 0], ends[at[ends] > 0]  # the first boundary is given, not predicted
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        raw = np.bincount(back, weight[ends], len(keys))
        opening = at[ends[first]] == n - 1  # reaches the boundary: nothing can come before
        if n < ORDER:  # lower orders count the different characters before
            longer, places = _ngrams(codes, at, n + 1)
            _, one = np.unique(longer, return_index=True)
            inner = places[one]
            position = np.full(len(codes), -1)
            position[ends] = back
            counts = np.bincount(position[inner], minlength=len(keys)).astype(float)
            counts = np.where(opening & (n > 1), raw, counts)
        else:
            counts = raw
        c = np.zeros(len(ends[first]), U)
        for i in range(n - 1, 0, -1):
            c = c * _BASE + codes[ends[first] - i]
        context, group = np.unique(mix(c + U(n - 1)), return_inverse=True)
        once, twice = max(1, np.sum(counts == 1)), max(1, np.sum(counts == 2))
        discount = min(0.95, once / (once + 2 * twice))
        total = np.maximum(np.bincount(group, counts), 1e-9)
        kinds = np.bincount(group, np.minimum(counts, discount))
        grams.append((keys, np.maximum(counts - discount, 0) / total[group]))
        contexts.append((context, kinds / total))
    return grams, contexts, codes, at, starts


def train(counts: dict[str, list[tuple[str, int]]], calibration: dict[str, list[list[str]]]) -> Models:
    """counts: words and how often they occur, by language; calibration: words of held-back documents, by language."""
    languages = sorted(counts)
    built, longest = [], []
    for language in languages:
        words = [w for w, _ in counts[language]]
        grams, contexts, codes, at, _ = _kneser_ney(words, np.array([n for _, n in counts[language]], float))
        built.append((grams, contexts))
        longest.append((codes, at))
    width = range(ORDER)
    models = Models(languages, [_order_table([g[n] for g, _ in built]) for n in width], [], (np.zeros(0, U), np.zeros((0, len(languages)))), np.full(len(languages), np.inf))
    for n in width:
        keys, values = _order_table([c[n] for _, c in built])
        for column, (_, c) in enumerate(built):  # a context that a language never saw passes all weight on
            values[~np.isin(keys, c[n][0]), column] = 1.0
        models.contexts.append((keys, values))
    keys, rows = [], []
    for codes, at in longest:  # every longest n-gram seen in training, resolved once
        places = np.flatnonzero(at > 0)
        h, one = np.unique(_longest(codes, at, places), return_index=True)
        keys.append(h)
        rows.append(models._interpolated(codes, at, places[one]))
    if keys:
        h, one = np.unique(np.concatenate(keys), return_index=True)
        models.whole = (h, np.concatenate(rows)[one])
    for column, language in enumerate(languages):
        models.limits[column] = _limit(models, column, [doc for doc in calibration.get(language, []) if doc])
    return models


def _limit(models: Models, column: int, docs: list[list[str]]) -> float:
    """Half-way between the entropies of held-back documents, but for the highest hundredth, and those of the
    same documents with their letters shuffled, but for the lowest hundredth. Nothing is rejected without documents."""

    def entropy(doc: list[str]) -> float:
        return -models.words(doc)[:, column].sum() / sum(len(w) + 1 for w in doc)

    def shuffled(doc: list[str], draw: np.random.Generator) -> list[str]:
        letters = iter(draw.permutation(list("".join(doc))))
        return ["".join(next(letters) for _ in w) for w in doc]

    if not docs:
        return np.inf
    draw = np.random.default_rng(len(docs))
    clean, junk = [entropy(d) for d in docs], [entropy(shuffled(d, draw)) for d in docs]
    high, low = np.quantile(clean, 1 - TAIL), np.quantile(junk, TAIL)
    return float(max(high, low) + high) / 2


class Scorer:
    """Cross-entropies of whole texts. Each different token is scored once, together with the other new ones
    of a few hundred texts, and kept as a row of a table that starts afresh when it is full."""

    def __init__(self, models: Models):
        self.models = models
        self.rows: dict[str, int] = {}
        self.used = 0
        self.table = np.zeros((CACHE, len(models.languages) + 1))  # log-probabilities by language, and characters

    def _learn(self, tokens: list[str]) -> None:
        start = self.used
        self.used += len(tokens)
        if start + len(tokens) > len(self.table):
            self.table = np.vstack((self.table[:start], np.zeros((start + 2 * len(tokens), self.table.shape[1]))))
        words, owner = [], []
        for i, token in enumerate(tokens, start):
            self.rows[token] = i
            for w in LETTERS.findall(token.lower()):
                words.append(w)
                owner.append(i)
        self.table[start : start + len(tokens)] = 0
        if words:
            np.add.at(self.table[:, :-1], owner, self.models.words(words))
            np.add.at(self.table[:, -1], owner, [len(w) + 1 for w in words])

    def score(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        languages = self.models.languages
        if not languages:
            return [(UND, 0.0, False)] * len(texts)
        split, rows = [t.split() for t in texts], self.rows
        if fresh := {t for tokens in split for t in tokens if t not in rows}:
            if self.used + len(fresh) > CACHE:
                rows.clear()
                self.used = 0
                fresh = {t for tokens in split for t in tokens}
            self._learn(sorted(fresh))
        out = []
        for tokens in split:
            sums = self.table[[rows[t] for t in tokens]].sum(axis=0) if tokens else self.table[0] * 0
            out.append(self._decide(sums[:-1], sums[-1]))
        for t in fresh:
            if len(t) > CACHED_CHARS:
                del rows[t]
        return out

    def _decide(self, sums: np.ndarray, chars: float) -> tuple[str, float, bool]:
        if not chars:
            return UND, 0.0, False
        entropy = np.round(-sums / chars, 9)  # the order of summation does not decide ties
        best = int(np.argmin(entropy))
        odds = np.exp(-np.minimum((entropy - entropy[best]) * min(chars, 200), 700))
        return self.models.languages[best], round(float(1 / odds.sum()), 6), bool(entropy[best] <= self.models.limits[best])


def predictor(spark: SparkSession, models: Models):
    """A function of a text column to struct<lang_pred, score, accepted>."""
    shared = spark.sparkContext.broadcast(models)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    @arrow_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.to_pylist()]
            for at in range(0, len(texts), ROWS):
                rows += scorer.score(texts[at : at + ROWS])
            yield pa.array([dict(zip(("lang_pred", "score", "accepted"), r, strict=True)) for r in rows], kind)

    return predict


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Learn from text and lang of documents that are not held out: about sample_docs of each language,
    drawn by a hash of the row so that every partition and source has its share. Of languages the MOST_LANGUAGES most frequent are learned."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return train({}, {})
    bounds = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, bound(sample_docs / n))])
    taken = draw("doc_id", "text", F.lit("langid")) <= bounds[F.col("lang")]
    checks = F.pmod(F.xxhash64("doc_id", "text", F.lit("calibration")), F.lit(5)) == 0
    sample = stage(rows.where(taken).select("lang", checks.alias("checks"), F.lower("text").alias("text")))
    run = F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    counts: dict[str, list] = defaultdict(list)
    for lang, word, n in sample.where("not checks").select("lang", run).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "word").toLocalIterator():
        counts[lang].append((word, n))
    if not counts and sample.isEmpty():
        raise RuntimeError("the sample of labelled documents is empty")
    calibration: dict[str, list] = defaultdict(list)
    for lang, text in sample.where("checks").select("lang", "text").toLocalIterator():
        calibration[lang].append(LETTERS.findall(text))
    return train(dict(counts), dict(calibration))


def predict(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """docs with a column lang_id: struct<lang_pred, score, accepted> added."""
    return docs.withColumn("lang_id", predictor(docs.sparkSession, models)(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = fit(docs)
    return predict(docs.select("doc_id", "text"), models).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_id.lang_pred", "lang_id.score", "lang_id.accepted")
