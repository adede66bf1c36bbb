"""run() against a plain version on a small corpus, and the entry point without the subpackage."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from tests.llm import brute

ROOT = Path(__file__).resolve().parents[2]


def corpus():
    draw = random.Random(12)
    words = brute.invented(3000, 7)
    item = " ".join(words[:30])
    bodies = ["\n".join(" ".join(draw.sample(words[50:], 25)) for _ in range(4)) for _ in range(20)]
    rows = list(enumerate(bodies))
    near = bodies[3].split("\n")
    rows += [(30, bodies[0]), (31, "\n".join([*bodies[1].split("\n"), "closing words of its own that are new"])), (32, f"{bodies[4].split(chr(10))[0]} {item}"), (33, "12345"), (34, None), (35, ""), (36, " ".join(x for line in near for x in line.split()[:-1]))]
    rows += [(40, " ".join(words[2000:2060])), (41, " ".join(words[2000:2059]) + " zzz")]
    return rows, [(1, item)]


def test_run(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "keep") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    named = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    cut = {i: t for i, t in brute.dedup_lines(named).items() if brute.normal_line(t)}
    single = {i: cut[i] for i, (_, c) in brute.near_components(list(cut.items())).items() if i == c}
    clean = {i: t for i, t in single.items() if not brute.contaminated(t, items)}
    assert set(found) == set(clean) and 32 not in found and 0 in found and 30 not in found and 41 not in found
    from tokenizers import Tokenizer

    from quillstack.llm.bpe import default_vocabulary

    known = Tokenizer.from_file(default_vocabulary())
    for i, t in clean.items():
        assert list(found[i]["ids"]) == known.encode(t, add_special_tokens=False).ids and found[i]["round_trip"]


def test_stages_keep_columns(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows[:8]], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_entry_without_subpackage(tmp_path):
    for name in ("quillstack", "__spark_entry__.py"):
        if name.endswith(".py"):
            shutil.copy(ROOT / name, tmp_path / name)
        else:
            shutil.copytree(ROOT / name, tmp_path / name, ignore=lambda d, files: ["llm"] if Path(d).name == "quillstack" else [])
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); print('fine')"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "PYTHONPATH": str(tmp_path), "HOME": "/root"}, capture_output=True, text=True)
    assert "fine" in said.stdout, said.stderr[-500:]
