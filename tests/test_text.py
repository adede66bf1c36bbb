"""Boundary cases of the text scalars and metrics."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.functions import metrics as M
from quillstack.functions import text as T
from quillstack.operators import corpus as C
from quillstack.operators import usage as U


def one(spark, value, f, *more):
    columns = [f"c{i}" for i in range(1 + len(more))]
    df = spark.createDataFrame([(value, *more)], ", ".join(f"{c} string" for c in columns))
    return df.select(f(*[F.col(c) for c in columns]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given_text", "expected"),
    [
        (T.skeleton, "a, b.c?", "abc"),
        (T.normalize, "[abc?] d[?]  e", "abc d e"),
        (T.normalize, "א־ב", "אב"),
        (T.normalize, "ם", "מ"),
        (T.uncertain_words, "x [a [b?] c", ["a [b"]),
        (T.move_leading_marks, "!abc", "abc!"),
        (T.move_leading_marks, "!?", "!?"),
        (T.move_leading_marks, "abc!", "abc!"),
        (T.strip_line_number, "12. abc", "abc"),
        (T.strip_line_number, "3) x", "x"),
        (T.strip_line_number, "4 x", "4 x"),
        (T.language, "123", "unknown"),
        (T.language, "אa", "mixed"),
        (T.language, "א", "he"),
        (T.language, "a", "en"),
        (T.flag, " YES ", True),
        (T.export_label, " a\nb ", "a b"),
    ],
)
def test_scalar(spark, f, given_text, expected):
    assert one(spark, given_text, f) == expected


@pytest.mark.parametrize(("text", "spaces", "split"), [("", 1, 0), ("a b", 2, 2), ("a  b", 3, 2), ("a\nb", 1, 2)])
def test_word_rules(spark, text, spaces, split):
    assert one(spark, text, T.spaces_plus_one) == spaces
    assert one(spark, text, lambda c: F.size(T.words(c))) == split


@pytest.mark.parametrize(("a", "b", "same", "place"), [("a,b", "ab", True, None), ("abc", "abd", False, 2), ("ab", "abc", False, 2)])
def test_punctuation_only(spark, a, b, same, place):
    assert one(spark, a, lambda x, y: T.skeleton(x) == T.skeleton(y), b) is same
    assert one(spark, a, lambda x, y: T.first_difference(T.skeleton(x), T.skeleton(y)), b) == place


@pytest.mark.parametrize(("cer", "name"), [(0.05, "excellent"), (0.0501, "good"), (0.60, "weak"), (0.61, "failure")])
def test_verdict(spark, cer, name):
    assert spark.range(1).select(M.verdict(F.lit(cer)).alias("v")).first()["v"] == name


def test_score_of_empty_reference(spark):
    row = M.score_pairs(spark.createDataFrame([("ab", "")], "hypothesis string, reference string")).first()
    assert (row["cer"], row["ref_chars"], row["ref_words"], row["wer"], row["cer_lenient"], row["length_ratio"]) == (2.0, 0, 1, 1.0, 0.0, 2.0)


def test_uncertain_marked(spark):
    assert M.score_pairs(spark.createDataFrame([("[a?] b[?]", "a")], "hypothesis string, reference string")).first()["uncertain_marked"] == 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


WORDS = st.lists(st.sampled_from(["a", "b", "cc", "d"]), max_size=8)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=20, max_size=40))
def test_word_distance(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    rows = df.select("a", "b", M.word_distance(F.col("a"), F.col("b")).alias("d"), M._folded_distance(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r["d"] == r["f"] == distance(r["a"], r["b"]) for r in rows)


def test_word_distance_of_long_texts(spark):
    """Thousands of words a side, most of them different."""
    a, b = [f"w{i}" for i in range(4000)], [f"w{i}" for i in range(0, 8000, 2)]
    df = spark.createDataFrame([(a, b), (a, a[1:]), (a, [])], "a array<string>, b array<string>")
    assert [r["d"] for r in df.select(M.word_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [distance(a, b), 1, 4000]


def test_words_beyond_the_first_plane(spark):
    n = M.SYMBOLS + 50
    df = spark.range(1).selectExpr(f"transform(sequence(1, {n}), i -> string(i)) AS a", f"transform(sequence(2, {n + 1}), i -> string(i)) AS b").selectExpr("slice(a, -60, 60) AS x", "a", "b")
    symbols = df.select(F.size("a").alias("n"), M.word_distance(F.col("x"), F.col("x")).alias("same")).first()
    assert (symbols["n"], symbols["same"]) == (n, 0)


def test_paths_keep_all_digits(spark):
    lines = spark.createDataFrame([(123456, 1234), (1, 2)], "page_id long, idx int")
    rows = C.asset_paths(lines).collect()
    assert [(r["page_path"], r["line_path"], r["context_path"]) for r in rows] == [("page123456.png", "p123456_l1234.png", "p123456_l1234_ctx.png"), ("page00001.png", "p00001_l002.png", "p00001_l002_ctx.png")]


def test_leading_marks_before_odd_line_ends(spark):
    row = spark.createDataFrame([("!a\u2028b",)], "t string").select(T.move_leading_marks(F.col("t")).alias("t")).first()
    assert row["t"].startswith("a")


def test_composition_of_all_code_points(spark):
    texts = ["".join(chr(c) for c in range(k, k + 0x100) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 0x100)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfkc(F.col("t")).alias("n")).collect()
    assert all(r["n"] == unicodedata.normalize("NFKC", r["t"]) for r in rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=20, max_size=40))
def test_composition_and_skeleton(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfkc(F.col("t")).alias("n"), T.skeleton(F.col("t")).alias("s")).collect()
    assert all(r["n"] == unicodedata.normalize("NFKC", r["t"]) for r in rows)
    assert all(r["s"] == "".join(r["t"].translate({ord(c): None for c in T.MARKS}).split()) for r in rows)


def test_upsert_keeps_id(spark):
    base = spark.createDataFrame([(1, 7, "old", "fix", None)], "id long, line_id long, text string, kind string, note string")
    changes = spark.createDataFrame([(5, 7, " x ", None, " "), (6, 7, "y", "sic", "n"), (8, 9, "z", None, None)], "seq long, line_id long, text string, kind string, note string")
    rows = sorted(map(tuple, C.upsert_corrections(base, changes).select("line_id", "id", "text", "kind", "note").collect()))
    assert rows == [(7, 1, "y", "sic", "n"), (9, 8, "z", "fix", None)]


def test_unknown_kind(spark):
    base = spark.createDataFrame([], "id long, line_id long, text string, kind string, note string")
    changes = spark.createDataFrame([(5, 7, "x", "maybe", None)], "seq long, line_id long, text string, kind string, note string")
    with pytest.raises(Exception, match="unknown kind"):
        C.upsert_corrections(base, changes).collect()


def test_replace_and_cascade(spark):
    lines = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "id long, page_id long, idx int")
    kept, gone = C.replace_lines(lines, spark.createDataFrame([(3, 1, 1)], lines.schema))
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]
    children = spark.createDataFrame([(1, "a"), (2, "b")], "line_id long, text string")
    assert [r["text"] for r in C.cascade(children, gone).collect()] == ["b"]


def test_export_numbers_have_gaps(spark):
    lines = spark.createDataFrame([(i, 1, i, f"{i}.png") for i in (1, 2, 3)], "id long, page_id long, idx int, image_path string")
    fixed = spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 3)], "line_id long, text string")
    rows = C.training_rows(lines, fixed, spark.createDataFrame([("1.png",), ("3.png",)], "image_path string"))
    assert sorted(r["file"] for r in rows.collect()) == ["00001.png", "00003.png"]


def test_cost_of_nothing(spark):
    empty = spark.createDataFrame([], "input_tokens int, output_tokens int, thinking_tokens int")
    assert all(v == 0 for v in U.cost_report(empty).first())


def test_distances_of_whole_documents(spark):
    """Those of plain versions, at a cost that follows the shorter text."""
    draw = random.Random(41)
    texts = ["", "a", "א b", "\U0001f600 x"] + [" ".join("".join(draw.choice("abו\U0001f600") for _ in range(draw.randint(1, 4))) for _ in range(n)) for n in (3, 9, 30)]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame([*pairs, (None, "a")], "a string, b string")
    found = df.select(M.distances(F.col("a"), F.col("b")).alias("d")).collect()
    assert [tuple(r["d"])[:2] for r in found[:-1]] == [(distance(a, b), distance(a.split(), b.split())) for a, b in pairs]
    assert found[-1]["d"] is None
    long = [draw.randrange(60) for _ in range(100_000)]
    assert M.sequence_distance(long, long[:40_000] + [99] + long[40_000:]) == 1
    assert M.sequence_distance(long, []) == 100_000
    report = M.score_pairs(spark.createDataFrame([("[a?] ב b", "a ב\u05b0 c", 7)], "hypothesis string, reference string, cer int")).first()
    assert (report["cer"], report["wer"], report["ref_words"], report["uncertain_marked"]) == (1 / 5, 1 / 3, 3, 1)


def test_whole_documents_are_dealt_out_and_normalized_once(spark):
    """A table of one file is no single task; with a text missing, what the other one gives stays."""
    pairs = spark.range(40, numPartitions=1).select(F.format_string("[x?] – a%d, b", "id").alias("hypothesis"), F.lit("x - (a7) בו").alias("reference"))
    report = M.score_pairs(pairs)
    assert len({r["task"] for r in report.select(F.spark_partition_id().alias("task")).collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(translate(") == 2
    plain = pairs.select(*[c.alias(n) for n, c in M.score(F.col("hypothesis"), F.col("reference")).items()])
    assert sorted(report.select(plain.columns).collect()) == sorted(plain.collect())
    texts = [(None, "a b"), ("a", None), ("", "- ."), ("x", "- ."), (None, "-"), (None, None), ("[a?] ״ ב–ו", "(a) ב"), ("😀 a", "😀")]
    odd = spark.createDataFrame(texts, "hypothesis string, reference string")
    plain = odd.select("*", *[c.alias(n) for n, c in M.score(F.col("hypothesis"), F.col("reference")).items()])
    assert sorted(map(str, M.score_pairs(odd).select(plain.columns).collect())) == sorted(map(str, plain.collect()))
