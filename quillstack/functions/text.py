"""Text scalars as Column -> Column functions; only compatibility normalisation needs Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points, markers and marks that results depend on.
WHITE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
MARKED_WORD = r"\[([^\]\[]+?)\?\]"
MARKED_GAP = r"\[\?\]"
UNREADABLE = r"\[unreadable\]|\[לא קריא\]|\[מחוק\]|\[crossed out\]|\[strikethrough\]"
VOWEL_POINTS = r"[\u0591-\u05C7]"
UNIFIED = ("\u05f4\u201d\u201c\u05f3\u2019\u2018\u05be\u2013\u2014", "\"\"\"'''---")
FINALS = ("ךםןףץ", "כמנפצ")
MARKS = ",.;:!?—"
MARKED_RUN = r"\[[^\]]+\?\]"
UNCERTAIN = r"\[([^\]]+)\?\]"
LINE_NUMBER = rf"^{WHITE}*(?:\d+[.):]{WHITE}*)?"
HEBREW, HEBREW_LETTER, LATIN = r"[\u0590-\u05FF]", r"[\u05D0-\u05EA\uFB1D-\uFB4E]", "[a-zA-Z]"
LEADING = r"(?s)^([!?.،؟]+)(.*)$"


def strip(c: Column) -> Column:
    """Without white space at either end, by the wide definition of white space."""
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{WHITE}+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{WHITE}+"), lambda w: w != "")


def unmark(c: Column) -> Column:
    """[word?] becomes the word."""
    return F.regexp_replace(c, MARKED_WORD, "$1")


def drop_gap_marks(c: Column) -> Column:
    return F.regexp_replace(c, MARKED_GAP, "")


def drop_unreadable(c: Column) -> Column:
    return F.regexp_replace(c, UNREADABLE, " ")


def drop_points(c: Column) -> Column:
    return F.regexp_replace(c, VOWEL_POINTS, "")


def unify_marks(c: Column) -> Column:
    return F.translate(c, *UNIFIED)


def fold_finals(c: Column) -> Column:
    return F.translate(c, *FINALS)


def drop_punctuation(c: Column) -> Column:
    """Keeps letters, digits, white space and both quotes."""
    return F.regexp_replace(c, r"(?U)[^\w\s'\"]", " ")


def nfkc(c: Column) -> Column:
    """Compatibility composition; the one step without a built-in."""
    @F.arrow_udf("string")
    def compose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in batch.to_pylist()], pa.string())

    return compose(c)


def normalize(c: Column, strip_punctuation: bool = False, compose: bool = True) -> Column:
    """Text as it is compared: markers resolved, points dropped, quotes, dashes and final letters unified."""
    t = fold_finals(unify_marks(drop_points(drop_unreadable(drop_gap_marks(unmark(nfkc(c) if compose else c))))))
    return collapse(drop_punctuation(t) if strip_punctuation else t)


def lenient(normalized: Column) -> Column:
    """Without punctuation and the letters that full and defective spelling differ in."""
    t = F.regexp_replace(F.regexp_replace(normalized, r"[=\-–—]", " "), r"[().,;:!?]", " ")
    return collapse(F.regexp_replace(t, "[יו]", ""))


def skeleton(c: Column) -> Column:
    """What punctuation must not change."""
    return F.regexp_replace(F.translate(c, MARKS, ""), rf"{WHITE}+", "")


def first_difference(a: Column, b: Column) -> Column:
    """The first place (from 0) where two texts differ, or the shorter length; null if they are equal."""
    shorter = F.least(F.length(a), F.length(b))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda i: F.substr(a, i + 1, F.lit(1)) != F.substr(b, i + 1, F.lit(1)))
    return F.when(a != b, F.coalesce(F.get(found, F.lit(0)), shorter))


def context(c: Column, place: Column, reach: int = 25) -> Column:
    start = F.greatest(place - reach, F.lit(0))
    return F.substr(c, start + 1, place + reach - start)


def marks_added(before: Column, after: Column) -> Column:
    return F.regexp_count(after, F.lit(f"[{MARKS}]")) - F.regexp_count(before, F.lit(f"[{MARKS}]"))


def language(c: Column) -> Column:
    hebrew, latin = c.rlike(HEBREW), c.rlike(LATIN)
    return F.when(hebrew & latin, "mixed").when(hebrew, "he").when(latin, "en").otherwise("unknown")


def direction(paragraph: Column, document_language: Column) -> Column:
    by_letters = F.when(paragraph.rlike(HEBREW_LETTER), "rtl").otherwise("ltr")
    return F.when(document_language == "he", "rtl").when(document_language == "en", "ltr").otherwise(by_letters)


def paragraphs(c: Column) -> Column:
    """Non-blank paragraphs, trimmed."""
    return F.filter(F.transform(F.split(c, rf"\n{WHITE}*\n"), strip), lambda p: p != "")


def move_leading_marks(c: Column) -> Column:
    """On every line, marks at its beginning move to its end; a line of marks alone stays."""

    def line(x: Column) -> Column:
        t = strip(x)
        marks, rest = F.regexp_extract(t, LEADING, 1), strip(F.regexp_extract(t, LEADING, 2))
        return F.when(marks == "", x).otherwise(F.when(rest == "", t).otherwise(F.concat(rest, marks)))

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def runs(c: Column) -> Column:
    """array<struct<text, uncertain>>: a text cut at its markers, empty runs left out."""
    plain = F.transform(F.split(c, MARKED_RUN), lambda t: F.struct(t.alias("text"), F.lit(False).alias("uncertain")))
    marked = F.transform(F.regexp_extract_all(c, F.lit(f"({MARKED_RUN})"), F.lit(1)), lambda t: F.struct(t.alias("text"), F.lit(True).alias("uncertain")))
    pairs = F.zip_with(plain, marked, lambda p, m: F.filter(F.array(p, m), lambda r: r.isNotNull()))
    return F.filter(F.flatten(pairs), lambda r: r["text"] != "")


def uncertain_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(UNCERTAIN), F.lit(1))


def strip_line_number(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), LINE_NUMBER, ""))


# Substrings of failure messages and the labels shown for them.
BLOCKED, FILTERED, QUOTA, KEY, MISSING = "נחסם על ידי NetFree", "נחסם על ידי מסנן רשת", "מכסה חרגה (429)", "בעיית מפתח API", "מודל לא נמצא"
BLOCK_PAGE = r"(//netfree\.link/block/#[^'\"}\s]+)"


def error_label(message: Column) -> Column:
    blocked = message.contains("blockByNetFree") | message.contains("netfree.link")
    key = message.contains("401") | message.contains("403") | F.upper(message).contains("API_KEY")
    return (
        F.when(blocked, BLOCKED)
        .when(message.contains("418") & F.lower(message).contains("block"), FILTERED)
        .when(message.contains("429"), QUOTA)
        .when(key, KEY)
        .when(message.contains("404"), MISSING)
        .otherwise(F.substring(message, 1, 200))
    )


def block_url(message: Column) -> Column:
    found = F.regexp_extract(message, BLOCK_PAGE, 1)
    return F.when(found != "", F.concat(F.lit("https:"), found))


def truncated(finish_reason: Column) -> Column:
    return F.coalesce(F.upper(finish_reason).contains("MAX_TOKENS"), F.lit(False))


def count_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def spaces_plus_one(c: Column) -> Column:
    """The word rule of the corpus totals: one more than there are spaces."""
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def export_label(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\n"), F.lit(" ")))


def flag(c: Column) -> Column:
    """How an environment setting is read as a boolean."""
    return F.lower(strip(c)).isin("1", "true", "yes", "on")


def size_cap(width: Column, height: Column, most: int = 4096) -> Column:
    """struct<width, height> scaled down so that neither side exceeds `most`."""
    longest = F.greatest(width, height)
    ratio = F.lit(float(most)) / longest
    scaled = lambda side: F.when(longest > most, (side * ratio).cast("int")).otherwise(side.cast("int"))
    return F.struct(scaled(width).alias("width"), scaled(height).alias("height"))
