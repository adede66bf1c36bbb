"""Sources, segmentation, model calls and the correction stream."""

import json
import zipfile

import numpy as np

from quillstack.operators import segment, transcribe
from quillstack.operators.numbering import number_rows
from quillstack.sources import files
from quillstack.streaming.corrections import follow_corrections


def test_numbers_are_consecutive(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x")
    rows = number_rows(df, "x").orderBy("x").collect()
    assert [r["number"] for r in rows] == list(range(1, 1001))


def test_texts_and_pairs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("  ")
    w = files.WORD[1:-1]
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("first", files.RULE + "x", "second"))
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    for name in ("a.png", "b.JPG", "d.png"):
        (tmp_path / name).write_bytes(b"x")
    texts = files.read_texts(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in texts.collect()} == {"a.txt": "one\ntwo", "b.txt": "  ", "c.docx": "first\nsecond"}
    images = files.scan_pages(spark, str(tmp_path))
    assert images.count() == 3
    place = texts.selectExpr("regexp_replace(path, '^file:/+', '/') AS path", "text")
    pairs = files.few_shot(images.selectExpr("regexp_replace(path, '^file:/+', '/') AS path"), place, 5)
    assert [r["stem"] for r in pairs.collect()] == ["a"]


def page_of_ink(lines, pitch, height, left, right, width):
    """Lines of ink in the middle third of each pitch."""
    ink = np.zeros((height, width), np.uint8)
    for k in range(lines):
        ink[k * pitch + pitch // 3 : k * pitch + 2 * pitch // 3, left:right] = 1
    return ink


def test_boxes_of_a_regular_page(spark):
    ink = page_of_ink(10, 60, 600, 40, 240, 300)
    pages = spark.createDataFrame([(1, ink.tobytes(), 300), (2, bytes(5000), 50), (3, None, 10), (4, b"\x01" * 7, 2), (5, b"", 3)], "page_id long, ink binary, width int")
    rows = sorted(segment.segment_pages(pages).collect(), key=lambda r: r["idx"])
    assert [r["idx"] for r in rows] == list(range(1, 11)) and {r["page_id"] for r in rows} == {1}
    # margins: 15 columns left of the first ink and right of the last, a fifth of a pitch above and below
    assert {(r["x0"], r["x1"]) for r in rows} == {(25, 254)}
    assert all(r["y0"] <= 60 * k + 20 and r["y1"] >= 60 * k + 40 for k, r in enumerate(rows))
    assert rows[0]["y0"] == 0 and rows[-1]["y1"] == 600 and all(r["y1"] - r["y0"] <= 86 for r in rows)
    # a cut is the first place of least ink: right behind a line, so the margin above reaches into it
    assert all(b["y0"] < a["y1"] for a, b in zip(rows, rows[1:], strict=False))


def test_little_ink_is_no_page():
    ink = np.zeros((200, 50), np.uint8)
    ink[100, :50] = ink[101, :49] = 1
    assert segment.boxes(ink) == []
    ink[101, 49] = 1
    assert len(segment.boxes(ink)) >= 1


def test_pitch_is_at_least_the_least_lag():
    profile = np.tile([9.0, 0, 0, 0], 30)
    assert segment.pitch(profile) in (8, 12, 16, 20)
    assert segment.kernel(9).sum() == 1.0 or abs(segment.kernel(9).sum() - 1) < 1e-12


def test_strong_line_takes_its_surroundings():
    profile = np.zeros(50)
    profile[[10, 13, 30, 45]] = [9, 8, 5, 1.7]
    assert segment.peaks(profile, 5).tolist() == [10, 30]


def test_failures_are_rows(spark):
    pages = spark.createDataFrame([(1, b"hello [you?]"), (2, b"\xff")], "page_number long, content binary")
    rows = {r["page_number"]: r for r in transcribe.transcribe(pages).collect()}
    assert rows[1]["success"] and rows[1]["uncertain_words"] == ["you"] and not rows[2]["success"] and rows[2]["error_label"]


def test_punctuation_guard(spark):
    df = spark.createDataFrame([("a b", True, "a, b."), ("a b", True, "a c"), ("a", False, "a."), ("a", True, None)], "text string, success boolean, punctuated string")
    assert [(r["text"], r["ok"]) for r in transcribe.accept_punctuation(df).collect()] == [("a, b.", True), ("a b", False), ("a", False), ("a", False)]


def test_stream_of_corrections(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    where = (str(log), str(tmp_path / "out"), str(tmp_path / "state"))
    (log / "1.json").write_text(json.dumps({"seq": 1, "line_id": 7, "text": "a", "kind": "fix", "note": None}))
    follow_corrections(spark, *where).awaitTermination()
    (log / "2.json").write_text(json.dumps({"seq": 2, "line_id": 7, "text": "b", "kind": "sic", "note": "n"}))
    follow_corrections(spark, *where).awaitTermination()
    rows = spark.read.parquet(f"{where[1]}/v1").collect()
    assert [(r["line_id"], r["id"], r["text"], r["kind"]) for r in rows] == [(7, 1, "b", "sic")]
