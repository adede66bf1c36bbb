"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import gzip
import hashlib
import io
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstack.llm import bpe, decontaminate, langid, lines, minhash, pii, substring, topk, toxicity, warc
from quillstack.llm.common import LAST_DRAW, Memo, attach, bound, stage
from quillstack.llm.common import draw as drawn_number
from quillstack.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
W = brute.invented(4000)


@pytest.fixture(scope="module")
def docs():
    """Ids and texts: copies, near copies, shared passages and lines, odd cases."""
    draw = random.Random(9)
    base = [" ".join(draw.sample(W, 90)) for _ in range(12)]
    passage = " ".join(draw.sample(W, 50))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0].upper()), (22, base[1].replace(" ", "  "))]
    for k in range(25):  # a family of near copies
        words = base[2].split()
        words[draw.randrange(len(words))] = draw.choice(W)
        rows.append((30 + k, " ".join(words)))
    rows += [(60, f"{base[3]} {passage}"), (61, f"{passage} {base[4]}"), (62, " ".join(["x"] * 80)), (63, "a b c"), (64, "A b c"), (65, ""), (66, None), (67, " \n\t "), (68, "\n".join([base[5], "Same line here, again!", base[6]])), (69, "same line here AGAIN\n***\n\n***")]
    rows += [(70, " ".join(draw.choice(W) for _ in range(30_000))), (71, "mail a.b@c.example.org or 10.20.30.40, +1 (555) 010-9999, 4111 1111 1111 1111, token = \"abcdef0123456789\""), (72, "你好 <|endoftext|> é̂ 🙂\x1c end")]
    return rows


@pytest.fixture(scope="module")
def table(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA)


@pytest.fixture(scope="module")
def folder(table, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    table.write.parquet(f"{root}/documents.parquet")
    return root


def empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("module", [bpe, langid, lines, minhash, pii, substring, topk, toxicity, warc, decontaminate], ids=lambda m: m.__name__.rsplit(".", 1)[1])
def test_empty_tables(spark, tmp_path, module):
    assert module.query(spark, empty(spark, tmp_path)).collect() == []


def test_bpe(spark, folder, docs):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(bpe.default_vocabulary())
    rows = {r["doc_id"]: r for r in bpe.query(spark, folder).collect()}
    for i, t in docs:
        ids = known.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == brute.sha(",".join(map(str, ids)))
        assert rows[i]["decoded_sha256"] == brute.sha(known.decode(ids, skip_special_tokens=False))


def test_bpe_strings():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(bpe.default_vocabulary())
    with open(bpe.default_vocabulary()) as f:
        own = bpe.Vocabulary(f.read())
    draw = random.Random(4)
    parts = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\r\n", "\t", "<|endoftext|>", "<|", "é", "1", "²", "漢", "🙂", "\x1c", "\x85", "​", "　", ".", "՘", "_", "zz" * 50]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 20)))
        ids = known.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(np.array(ids, np.int32)) == known.decode(ids, skip_special_tokens=False)
    with pytest.raises(KeyError):
        own.decode(np.array([10**6], np.int64))


def test_bpe_decoder(spark):
    with open(bpe.default_vocabulary()) as f:
        content = f.read()
    df = spark.createDataFrame([([64, 65],), ([],), (None,)], "ids array<int>")
    assert [r["t"] for r in df.select(bpe.decoder(spark, content)(F.col("ids")).alias("t")).collect()] == ["ab", "", ""]
    texts = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [len(r["x"]) for r in texts.select(bpe.encoder(spark, content)(F.col("t")).alias("x")).collect()] == [1, 0]


def test_language_accuracy(spark):
    folder = "/root/testdata/sf0.001"
    rows = langid.query(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.9


def test_language_cases(spark):
    english, german = ("the cat and the dog sat on the mat", "der hund und die katze auf dem dach")
    train = spark.createDataFrame([(i, english if i % 2 else german, "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    models = langid.fit(train)
    odd = spark.createDataFrame([("the dog", "x"), ("die katze", "x"), (None, "x"), ("", "x"), ("123 !", "x"), ("the " * 50_000, "x"), ("qzxj wvkq " * 9, "x")], "text string, lang_pred string")
    rows = [r["lang_id"] for r in langid.predict(odd, models).collect()]
    assert [r["lang_pred"] for r in rows[:6]] == ["en", "de", "und", "und", "und", "en"]
    assert [r["accepted"] for r in rows] == [True, True, False, False, False, True, False]
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_letters_decide_about_und(spark):
    models = langid.train({"en": [("the", 5), ("dog", 3)]}, {})
    texts = ["²", "½", "Ⅷ ①", "٣", "_", "²a", "ñ"]
    df = spark.createDataFrame([(t, "mine") for t in texts], "text string, lang_id string")
    assert [r["lang_id"]["lang_pred"] for r in langid.predict(df, models).collect()] == ["und"] * 5 + ["en"] * 2


def test_rejection_is_calibrated(spark):
    """Of documents that the limit was not made from: clean ones stay, shuffled and foreign ones go."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    models = langid.fit(docs)
    draw = random.Random(3)
    texts = [r["text"] for r in docs.where(langid.held_out(F.col("doc_id")) & (F.length("text") > 200)).orderBy("doc_id").collect()]

    def mixed(text):
        letters = [c for c in text if c.isalpha()]
        draw.shuffle(letters)
        left = iter(letters)
        return "".join(next(left) if c.isalpha() else c for c in text)

    share = lambda made: np.mean([r["lang_id"]["accepted"] for r in langid.predict(spark.createDataFrame([(t,) for t in made], "text string"), models).collect()])
    print("accepted: clean", share(texts), "shuffled", share([mixed(t) for t in texts]))
    assert share(texts) >= 0.99 and share([mixed(t) for t in texts]) <= 0.02 and share(["Съешь же ещё этих мягких французских булок", "漢字かな交じり文の例" * 3]) == 0


@pytest.mark.parametrize("n", [3, 6 * 10**8, 10**10, 10**13])
def test_no_share_of_a_sample_is_too_small(spark, n):
    """What is drawn of n rows: the bound is never nought, and a million draws are about the share."""
    assert bound(600 / n) >= 1 and bound(1.0) == bound(200.0) == LAST_DRAW
    drawn = spark.range(1_000_000).where(drawn_number("id") <= bound(600 / n)).count()
    expected = min(1.0, 600 / n) * 1e6
    assert abs(drawn - expected) <= 6 * math.sqrt(expected) + 1


def test_kneser_ney_sums_to_one():
    models = langid.train({"a": [("abab", 3), ("abba", 2), ("bab", 1)], "b": [("bbbb", 2)]}, {})
    for before in ("", "a", "ab", "abab", "zz"):
        total = sum(np.exp(_last(models, before + c)) for c in "ab") + np.exp(_end(models, before))
        assert 0.9 < total <= 1 + 1e-6  # the rest is for characters never seen


def _last(models, word):
    codes, at, _ = langid._laid_out([word])
    return models.log_probabilities(codes, at)[len(word), 0]


def _end(models, word):
    codes, at, _ = langid._laid_out([word])
    return models.log_probabilities(codes, at)[len(word) + 1, 0]


def test_topk(spark, tmp_path):
    draw = np.random.default_rng(2)
    vectors = {i: draw.normal(0, 0.2, 16).tolist() for i in range(300)}
    vectors |= {i: vectors[7] for i in range(300, 340)}  # ties
    rows = [(i, v, 0) for i, v in vectors.items()] + [(400, None, 0), (450, [None] * 16, 0), (500, [float("nan")] * 16, 0), (550, [float("inf")] + [0.0] * 15, 0), (None, vectors[1], 0), (600, [0.5, -0.5], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted(map(tuple, topk.query(spark, str(tmp_path)).collect()))
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors.items()}
    whole[600] = np.array([128, -128] + [0] * 14)
    expected = []
    for q in sorted(i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert found == expected


def test_topk_few_and_repeated(spark):
    v = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (1, [3, 4])], "vec_id long, v array<int>")
    assert sorted(map(tuple, topk.top_k(v.where("vec_id = 0"), v).collect())) == [(0, 1, 1, 11), (0, 2, 1, 11)]


def brute_top(vectors, queries, k=5):
    """vectors: (id, list of Python integers)."""
    low, high = -(1 << 63), (1 << 63) - 1
    out = []
    for q, v in queries:
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), low), high), i) for i, w in vectors if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_topk_components_of_any_size(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, [draw.choice([1e10, -1e10, 3.7e9, 1e200, -2e300, 5e-324, -1e-9, 0.5, 123456.789]) for _ in range(4)], "x") for i in range(60)]
    rows += [(60, [1.7e308] * 4, "x"), (61, [], "x")]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, [math.floor(256 * x) for x in v] if all(abs(256 * x) < 2**51 for x in v) else [int(256 * x) if abs(256 * x) >= 2**51 else math.floor(256 * x) for x in v]) for i, v, _ in rows if i != 60]
    assert sorted(map(tuple, topk.query(spark, str(tmp_path)).collect())) == brute_top(whole, [w for w in whole if w[0] % 50 == 0])


def test_topk_prunes_and_stays_exact():
    """Shards of several sizes, with ties, against plain products; thresholds leave most candidates unscored."""
    draw = np.random.default_rng(3)
    c = np.floor(draw.normal(0, 60, (3000, 24)) * np.linspace(4, 0.1, 24))
    c[1000:1040] = c[7]
    ids = np.arange(3000)
    shard = topk.Shard(ids, c)
    q = c[::50]
    exact = c @ q.T
    exact[ids[::50], np.arange(len(q))] = -np.inf
    expected = [sorted(((int(s), int(i)) for i, s in enumerate(exact[:, n]) if np.isfinite(s)), key=lambda x: (-x[0], x[1]))[:5] for n in range(len(q))]
    none = list(shard.search(ids[::50], q, np.full(len(q), -np.inf), 5))
    assert none == expected
    best = np.array([float(e[-1][0]) for e in expected])
    assert list(shard.search(ids[::50], q, best, 5)) == expected
    assert all(not top for top in shard.search(ids[::50], q, np.full(len(q), 1e9), 5))


def test_topk_shuffles_in_proportion(spark, tmp_path, monkeypatch):
    """Four times the vectors, in shards of one size: each candidate is in one shard, and a shard gives k rows a query."""
    monkeypatch.setattr(topk, "SHARD", 256)
    draw = np.random.default_rng(5)
    made = {}
    for n in (500, 2000):
        df = spark.createDataFrame([(i, draw.integers(-99, 99, 6).astype(float).tolist()) for i in range(n)], "vec_id long, v array<double>")
        rows = topk.top_k(df.where("vec_id % 50 = 0"), df).collect()
        made[n] = len(rows)
        vectors = [(r["vec_id"], [int(x) for x in r["v"]]) for r in df.collect()]
        assert sorted(map(tuple, rows)) == brute_top(vectors, [v for v in vectors if v[0] % 50 == 0])
    assert made == {500: 50, 2000: 200}


def test_minhash(spark, folder, docs):
    rows = minhash.query(spark, folder).collect()
    expected = brute.near_components(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_minhash_repeats_nulls_and_other_columns(spark):
    text = " ".join(W[:20])
    df = spark.createDataFrame([(5, text, 1, "a"), (5, text, 1, "a"), (3, text + " ", 2, "b"), (None, text, 3, "c"), (9, "", 4, "d"), (9, None, 5, "e")], "doc_id long, text string, n long, _k string")
    rows = sorted(minhash.components_of(df).collect(), key=str)
    assert sum(r["kept"] for r in rows if r["n_shingles"]) == 1 and {r["component_id"] for r in rows if r["n_shingles"]} == {3}
    left = minhash.keep_one(df).collect()
    assert left[0].asDict().keys() == {"doc_id", "text", "n", "_k"} and sorted((r["doc_id"], r["n"]) for r in left) == [(3, 2), (9, 4), (9, 5)]


def test_odd_sketches_estimate():
    a = minhash.mix(np.arange(1000, dtype=np.uint64))
    b = np.sort(np.concatenate((a[:900], minhash.mix(np.arange(5000, 5100, dtype=np.uint64)))))
    x, y = (minhash.odd_sketch(minhash.signature(np.sort(s))) for s in (a, b))
    differing = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
    estimate = 1 + minhash.SKETCH_BITS / (4 * minhash.SAMPLES) * np.log(1 - 2 * differing / minhash.SKETCH_BITS)
    assert abs(estimate - 900 / 1100) < 0.15


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 201), (205, 201), (300, 300)]
    rows = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in rows} == {i: 0 for i in range(61)} | {200: 200, 201: 200, 205: 200}


def test_attach_both_ways(spark, monkeypatch):
    left, small = spark.range(50).withColumnRenamed("id", "k"), stage(spark.createDataFrame([(3, b"x"), (7, None)], "k long, v binary"))
    narrow = sorted(map(tuple, attach(left, small, "k", ["v"], "inner").collect()))
    monkeypatch.setattr("quillstack.llm.common.BROADCAST_BYTES", 0)
    wide = attach(left, small, "k", ["v"], "inner")
    assert "BroadcastHashJoin" not in wide._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, wide.collect())) == narrow


def test_pii(spark, folder, docs):
    rows = {r["doc_id"]: r for r in pii.query(spark, folder).collect()}
    for i, t in docs:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute.personal_data(t or ""))
        assert rows[i]["base_sha256"] == brute.sha(base)
        assert set(filter(None, base.split(","))) <= set(rows[i]["spans"].split(","))
    assert [rows[71][f"n_{k}"] for k in pii.BASE] == [1, 1, 1, 1] and "account:" in rows[71]["spans"]


def test_pii_strings():
    draw = random.Random(3)
    for _ in range(5000):
        text = "".join(draw.choice("0123456789.@@ab-+ ()_%.1.2.é\n") for _ in range(draw.randint(0, 60)))
        assert [s for s in pii.find(text) if s[1] < 4] == brute.personal_data(text)


def test_pii_accounts_are_whole():
    long = "a1" * 200
    for text, value in [(f"token = {long}", long), ("password = correcthorse", "correcthorse"), ("iban DE89 3704 0044 0532 0130 00 and more", "DE89 3704 0044 0532 0130 00"), ("account number: 12345678", "12345678"), ("Account No. 12345678", "12345678"), ("aPi_KeY: abc12345", "abc12345"), ("my iban is GB82WEST12345698765432.", "GB82WEST12345698765432"), ("İ ssn 123-45-6789", "123-45-6789")]:
        assert [text[a:b] for a, k, b in pii.find(text) if pii.KINDS[k] == "account"] == [value], text
    for text in ("password protection", "the secret is wonderful", "token-token-token1234", "account number theory"):
        assert not pii.find(text)
    url = f"http://{'u' * 300}@example.org"
    assert (0, 5, len(url)) in pii.find(url)


def test_lines(spark, folder, docs):
    expected = brute.dedup_lines(docs)
    rows = lines.query(spark, folder).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in rows if r["kept_sha256"]} == {i: brute.sha(t) for i, t in expected.items()}
    assert {r["doc_id"]: r["n_removed"] for r in rows}[69] == 1


def test_line_families_and_long_lines(spark):
    draw = random.Random(6)
    base = draw.sample(W, 120)
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        words = list(base)
        words[draw.randrange(120)] = draw.choice(W)
        rows.append((k, " ".join(words)))
    rows += [(50, " ".join(W[:700])), (51, " ".join(W[:700]) + " x"), (52, "\n\n"), (53, "a"), (54, "A!\nb")]
    expected = brute.dedup_lines(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, drop int")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == expected


def test_lines_against_edit_similarity(spark):
    """One or two replaced, added or mistyped words: whatever the distance of fingerprints."""
    draw = random.Random(11)
    texts = []
    for n in [2, 3, 4, 6, 9, 12, 12, 15, 20, 25, 30, 36, 45, 60, 90, 150]:
        base = draw.sample(W, n)
        texts.append(" ".join(base))
        for _ in range(3):
            words = list(base)
            for _ in range(draw.randint(1, 2 if n > 12 else 1)):
                at = draw.randrange(n)
                word = words[at]
                words[at] = draw.choice([draw.choice(W), word[:-1], word + "q", word[:1] + "z" + word[1:]])
            texts.append(" ".join(words))
    han = "".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(60))
    texts += [han, han[:30] + "x" + han[31:], "abcdefghijklmnopqr", "abcdefghiXjklmnopqr"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == brute.dedup_lines(rows)


def changed(draw, words, kind):
    """The words with one letter or word changed, or with as many words as ten characters in a hundred allow."""
    words = list(words)
    size = len(" ".join(words))
    if kind == "letter":
        at = draw.randrange(len(words))
        k = draw.randrange(len(words[at]))
        words[at] = words[at][:k] + "z" + words[at][k + 1 :]
    elif kind == "word":
        words[draw.randrange(len(words))] = draw.choice(W)
    else:
        left = size // 10
        while left >= 6:
            at = draw.randrange(len(words))
            new = draw.choice(W)
            left -= max(len(words[at]), len(new))
            words[at] = new
    return words


def test_recall_of_similar_lines(spark):
    """Held against the edit distance alone, for lines of 3 to 100 words and three kinds of change."""
    draw = random.Random(21)
    rows, linked, equal = [], defaultdict(list), set()
    for n in (3, 5, 8, 12, 20, 40, 100):
        for kind in ("letter", "word", "words"):
            for _ in range(40):
                base = draw.sample(W, n)
                a, b = " ".join(base), " ".join(changed(draw, base, kind))
                if a != b and brute.distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9):
                    linked[n].append(len(rows) + 1)
                equal |= {len(rows) + 1} if a == b else set()
                rows += [(len(rows), a), (len(rows) + 1, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"] for r in lines.dedup_lines(df).where("n_removed = 1").collect()}
    recall = {n: sum(i in gone for i in ids) / len(ids) for n, ids in linked.items()}
    print("recall by words a line", recall)
    assert set(recall) == {3, 5, 8, 12, 20, 40, 100} and min(recall.values()) >= 0.9, recall
    assert gone <= equal | {i for ids in linked.values() for i in ids}


def compared_pairs(monkeypatch, module):
    """What link_buckets() returns to a module, call by call."""
    calls, plain = [], module.link_buckets
    monkeypatch.setattr(module, "link_buckets", lambda *a: calls.append(plain(*a)) or calls[-1])
    return calls


def family(draw, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(*changes)):
            words[draw.randrange(len(words))] = draw.choice(W)
        out.append(" ".join(words))
    return out


def test_large_family_of_near_copies(spark, monkeypatch):
    """Some copies are too far from all others. Brute force gives the same groups, and few of all pairs are compared
    (the README has the figures; they grow faster than the family, as more copies meet by chance near the threshold)."""
    calls = compared_pairs(monkeypatch, minhash)
    draw = random.Random(12)
    base = draw.sample(W, 150)
    copies = family(draw, base, 600, (0, 7))
    for n in (150, 600):
        rows = list(enumerate(copies[:n]))
        found = {r["doc_id"]: r["component_id"] for r in minhash.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        if n == 150:
            assert found == {i: c for i, (_, c) in brute.near_components(rows).items()}
        assert calls[-1].compared <= 0.05 * n * (n - 1) / 2


def test_large_family_of_lines(spark):
    """The groups are nearly those of brute force. (Lines near the threshold are compared with most of their family.)"""
    draw = random.Random(13)
    rows = list(enumerate(family(draw, draw.sample(W, 40), 200, (0, 6))))
    left = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=False).collect()}
    expected = brute.dedup_lines(rows)
    assert sum(t != "" for t in expected.values()) <= sum(t != "" for t in left.values()) <= 1.1 * sum(t != "" for t in expected.values())


def test_line_columns_of_the_caller(spark):
    df = spark.createDataFrame([(1, "a b c\na b c", 7, "x", None)], "doc_id long, text string, n_lines int, `a.b` string, keys string")
    rows = lines.dedup_lines(df)
    assert rows.columns == ["doc_id", "text", "a.b", "keys", "n_lines", "n_removed"] and tuple(rows.first()) == (1, "a b c", "x", None, 2, 1)
    assert lines.dedup_lines(df, counts=False).columns == df.columns
    assert lines.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 127, 128, 300, 5000])
def test_simhash_is_a_majority(spark, n):
    row = spark.sql(f"SELECT transform(sequence(1, {n}), i -> xxhash64(i)) AS hs").withColumn("n", F.size("hs")).select("hs", lines.simhash("hs", "n").alias("f")).first()
    assert row["f"] == sum(1 << b for b in range(lines.BITS) if 2 * sum((h >> b) & 1 for h in row["hs"]) > n)


def test_repeated_rows_of_lines(spark):
    df = spark.createDataFrame([(1, "x y z\nq"), (1, "x y z\nq"), (None, "x y z")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in lines.dedup_lines(df, counts=False).collect()) == [("1", "x y z\nq"), ("1", "x y z\nq"), ("None", "")]


def test_decontamination(spark, folder, docs):
    draw = random.Random(8)
    items = [(k, " ".join(draw.sample(W, n))) for k, n in enumerate((40, 40, 25, 12, 3))] + [(9, None), (10, "  ")]
    planted = [(100, f"{docs[1][1]} {items[0][1].upper()}, {docs[2][1]}"), (101, items[2][1]), (102, f"so {items[4][1]}!"), (103, " ".join(items[1][1].split()[:15])), (104, " ".join(items[0][1].split()[:-1] + ["zzz"]) + " tail")]
    rows = [*docs, *planted]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: {m["item_id"] for m in r["matches"]} for r in decontaminate.find_benchmark_passages(df, bench).collect()}
    assert found == {i: brute.contaminated(t, [x for x in items if x[1]]) for i, t in rows}
    assert found[100] == {0} and found[101] == {2} and found[102] == {4} and not found[103] and found[104] == {0}


def test_decontamination_of_documents_shorter_than_items():
    items = [(k, " ".join(W[50 * k : 50 * k + n])) for k, n in enumerate((40, 40, 7, 4))]
    index = decontaminate.Index(items)
    goals = {k: decontaminate.weighted(t.split(), decontaminate.word_codes(t.split())) for k, t in items}
    for k, t in items:
        words = t.split()
        for part in [words[:-1], words[1:], words[2:-2], words[: len(words) * 4 // 5], words[:3], words[:-3] + ["zzz"]]:
            own = decontaminate.weighted(part, decontaminate.word_codes(part))
            expected = {i for i, goal in goals.items() if decontaminate.similarity(own, goal) >= 0.75}
            assert {m[0] for m in index.find(" ".join(part))} == expected
    assert index.find(" ".join(items[0][1].split()[:-1]))[0][:3] == (0, 0, 39)


def test_decontamination_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", 100)
    bench = spark.createDataFrame([(k, " ".join(W[9 * k : 9 * k + 9])) for k in range(5)], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(W[:30]))], "doc_id long, text string")
    assert {m["item_id"] for m in decontaminate.find_benchmark_passages(df, bench).first()["matches"]} == {0, 1, 2}


def test_toxicity_learns_pairs():
    terms = toxicity.Terms()
    draw = random.Random(5)
    train = []
    for _ in range(3000):
        words = draw.sample(W[:200], 6)
        insult, group = draw.random() < 0.4, draw.random() < 0.4
        words += ["insult"] * insult + ["group"] * group
        train.append((terms.of(" ".join(words)), int(insult and group)))
    machine = toxicity.train(train)
    both, one, other, none = (machine.score(terms.of(t)) for t in ("insult group", "insult", "group", ""))
    assert both > 0.8 and max(one, other, none) < 0.2


def test_toxicity_learns_pairs_without_marginal_effect():
    """As many rows are toxic with the group as without it: only its pairs tell."""
    terms, draw, rows = toxicity.Terms(), random.Random(5), []
    for _ in range(4000):
        kind, group = draw.choice(("insult", "slur", "")), draw.random() < 0.4
        text = " ".join([*draw.sample(W[:200], 6), kind, "group" * group])
        rows.append((terms.of(text), int(kind == "insult" and group or kind == "slur" and not group)))
    machine = toxicity.train(rows[:3500])
    assert np.mean([(machine.score(t) >= 0.5) == y for t, y in rows[3500:]]) > 0.9


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = toxicity.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    high, low = ([r["score"] for r in rows if r["toxic"] == x] for x in (1, 0))
    assert np.mean([[a > b for b in low] for a in high]) > 0.8
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_substring(spark, folder, docs):
    rows = {r["doc_id"]: tuple(r)[1:] for r in substring.query(spark, folder).collect()}
    assert [rows[i] for i, _ in docs] == brute.without_repeats(docs)


def test_substring_repeated_rows(spark):
    text = " ".join(W[:40])
    rows = [(1, text), (1, text), (2, " ".join(W[100:150])), (None, " ".join(["a", "b"] * 30))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string")
    found = sorted(((r["n_words"], r["n_removed"], brute.sha(r["kept"])) for r in substring.remove_repeats(df).collect()))
    assert found == sorted(brute.without_repeats(rows))


def test_anchors_lose_no_repeat():
    draw = random.Random(5)
    for _ in range(100):
        texts = [[draw.choice("ab") if draw.random() < 0.9 else "c" for _ in range(draw.randint(30, 120))] if draw.random() < 0.5 else (["a", "b", "c"][: draw.randint(1, 3)] * 60)[: draw.randint(34, 90)] for _ in range(3)]
        runs = [substring.anchor_runs(substring.word_hashes(" ".join(t).encode())) for t in texts]
        weight, seen = {}, {}
        for r in runs:
            for h, w in zip(r[0], r[3], strict=True):
                weight[h] = weight.get(h, 0) + w
        for t in texts:
            for k in range(len(t) - 34):
                seen[tuple(t[k : k + 35])] = seen.get(tuple(t[k : k + 35]), 0) + 1
        for t, r in zip(texts, runs, strict=True):
            kept = {k for h, s, n, _ in zip(*r, strict=True) if weight[h] > 1 for k in range(s, s + n)}
            assert all(k in kept for k in range(len(t) - 34) if seen[tuple(t[k : k + 35])] > 1)


def test_long_words_and_pieces():
    text = (" ".join(W) * 60 + " " + "y" * 3_000_000 + " end").encode()
    whole = substring.word_hashes(text)
    assert len(whole) == len(text.split()) and whole[-1] == substring.word_hashes(b"end")[0]


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc(spark, tmp_path):
    rows = [(5, "http://a/ü x", "one"), (3, None, "one"), (9, "http://b", None), (2, "http://c", ""), (None, "http://d", "one"), (7, "http://e", "two"), (8, "http://f", "z" * 3_000_000), (8, "http://f", "z" * 3_000_000)]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(map(tuple, warc.query(spark, str(tmp_path)).collect()), key=str)
    first = {"one": 3, "": 2, "two": 7, "z" * 3_000_000: 8}
    expected, taken = [], set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lead = (html or "") not in taken and i == first[html or ""]
        taken |= {html or ""} if lead else set()
        expected.append((i, len((html or "").encode()), sha1(html), "response" if lead else "revisit", None if lead else first[html or ""]))
    assert found == sorted(expected, key=str)


def test_warc_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    held = warc.write_archives(pages, str(tmp_path / "w"), min_bytes=3)
    assert sorted((r["page_id"], r["record_type"]) for r in warc.page_records(warc.read_archives(held, str(tmp_path / "w"))).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def salvaged(data):
    return [(x.start, x.end, x.why) if isinstance(x, warc.Gap) else x.headers["warc-record-id"] for x in warc.Salvage(io.BytesIO(data), len(data))]


def test_salvage():
    members = [warc.record(str(i), i, "http://x", f"payload {i}".encode() * 50, None) for i in range(4)]
    name = [f"<urn:page:{i}:{i}>" for i in range(4)]
    ends = np.cumsum([0, *map(len, members)]).tolist()
    assert salvaged(b"".join(members)) == name
    broken = bytearray(b"".join(members))
    broken[ends[1] + 30] ^= 0xFF
    got = salvaged(bytes(broken))
    assert [got[0], *got[2:]] == [name[0], name[2], name[3]] and got[1][:2] == (ends[1], ends[2])
    assert salvaged(b"junk" + members[0])[0][:2] == (0, 4)
    cut = salvaged(members[0] + members[1][:-5])
    assert cut[0] == name[0] and cut[1][:2] == (ends[1], ends[2] - 5)
    plain = b"".join(gzip.decompress(m) for m in members[:3])
    assert salvaged(plain) == name[:3]
    at = plain.index(b"payload 1")
    spoilt = plain[:at] + b"X" + plain[at + 1 :]
    got = salvaged(spoilt)
    assert [got[0], got[2]] == [name[0], name[2]] and got[1][2] == "wrong digest"
    assert salvaged(b"") == []


def test_warc_gaps_are_rows(spark, tmp_path):
    members = [warc.record(str(i), i, None, b"x", None) for i in range(2)]
    (tmp_path / "a.warc.gz").write_bytes(members[0] + b"garbage" + members[1])
    rows = warc.read_archives(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string"), str(tmp_path), with_payload=True).collect()
    assert [(r["problem"] is None, r["payload"]) for r in rows] == [(True, b"x"), (False, None), (True, b"x")] and rows[1]["end"] - rows[1]["start"] == 7


def test_top_k_of_tables_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    some = spark.createDataFrame([(1, [1.0])], "vec_id long, v array<double>")
    assert topk.top_k(none, none).count() == topk.top_k(none, some).count() == topk.top_k(some, none).count() == 0


def test_pairs_of_short_lines_that_share_a_piece(spark, monkeypatch):
    """Character pairs rule out most lines that share a piece by chance; linked ones are all found."""
    calls = compared_pairs(monkeypatch, lines)
    draw = random.Random(31)
    texts = ["".join(draw.choice("abcdefghijklmnoprstuvwxyz") for _ in range(31)) + "quantities" for _ in range(150)]
    texts += [t[:20] + "q" + t[21:] for t in texts[:20]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, counts=False).collect()} == brute.dedup_lines(rows)
    assert calls[-1].compared <= 300


def test_pairs_of_lines_are_compared_without_a_table(spark, monkeypatch):
    """Short and long lines are linked by their edit distance, and no table is written on the way."""
    draw = random.Random(33)
    texts = []
    for n in (12, 90, 240):
        base = draw.sample(W, n)
        for share in (0.02, 0.06, 0.12, 0.9):
            texts.append((" ".join(base), " ".join(draw.choice(W) if draw.random() < share else w for w in base)))
        texts.append((" ".join(base), " ".join(base[1:] + base[:1])))
    allowed = [int(max(map(len, t)) * (1 - lines.SIMILARITY) + 1e-9) for t in texts]
    expected = {i for i, (a, b) in enumerate(texts) if brute.distance(a, b) <= allowed[i]}
    assert 3 <= len(expected) <= len(texts) - 3
    kind = lines._Lines(None, None)
    kind.texts = spark.createDataFrame([(2 * i + k, t[k]) for i, t in enumerate(texts) for k in (0, 1)], "id long, norm string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(texts))], "a long, b long")

    def no_table(*args, **kwargs):
        raise AssertionError("a table was written")

    monkeypatch.setattr(lines, "stage", no_table)
    assert {r["a"] // 2 for r in kind.verify(pairs).collect()} == expected


def test_far_fingerprints_do_not_drop_a_line(spark, monkeypatch):
    """Lines that share a key are linked by their edit distance, however far their SimHashes are apart."""
    monkeypatch.setattr(lines, "RADIUS", -1)
    draw = random.Random(32)
    rows = []
    for n in (20, 30, 60):
        base = draw.sample(W, n)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:-1], "q"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, counts=False).collect()} == brute.dedup_lines(rows)


def test_bpe_remembers_a_word_once():
    """Chunks and pre-tokens share one memo, so that a worker's memory holds twice as many."""
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    whole = vocabulary.encode("some words some words, don't12 x''s")
    memos = [x for x in vars(vocabulary).values() if isinstance(x, Memo)]
    assert len([k for m in memos for k in m if k == " words"]) == 1
    assert vocabulary.decode(whole) == "some words some words, don't12 x''s"


def test_letters_bound_the_edit_distance(spark):
    """Counted letters that a line has and another lacks; a sum beyond a counter's width only turns out smaller."""
    draw = random.Random(43)
    texts = [("".join(draw.choices("abcxyz é0"[: draw.randint(2, 9)], k=draw.randint(0, 40))), "".join(draw.choices("abcxyz é0", k=draw.randint(0, 40)))) for _ in range(60)]
    df = spark.createDataFrame([*texts, ("a" * 40_000, "b"), ("ab" * 20_000, "c" * 40_000)], "a string, b string").withColumns({"n": F.length("a"), "m": F.length("b")})
    found = [r["x"] for r in df.select(lines.more_letters(lines.letters("a", "n"), lines.letters("b", "m")).alias("x")).collect()]

    def more(a, b):
        a, b = ([c if c in lines.COUNTED else "?" for c in t] for t in (a, b))
        return sum(max(0, a.count(c) - b.count(c)) for c in set(a))

    assert found[:-2] == [more(a, b) for a, b in texts]
    assert all(0 <= x <= 40_000 for x in found[-2:])


def test_lines_with_a_common_passage(spark, monkeypatch):
    """Lines that have a long passage in common, and little else, are not compared pair by pair."""
    draw, n = random.Random(44), 40
    passage = " ".join(draw.sample(W, 45))
    rows = []
    for i in range(n):
        few = draw.sample("bcdfghjklmnpqrstvwxz", 4)
        rows.append((i, " ".join("".join(draw.choices(few, k=5)) for _ in range(20)) + " " + passage))
    rows += [(100 + i, rows[i][1].replace(passage.split()[7], "changed")) for i in range(5)]
    calls = compared_pairs(monkeypatch, lines)
    monkeypatch.setattr(lines._Lines, "neighbours", 0, raising=False)
    left = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=False)
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {i: t if i < n else "" for i, t in rows}
    assert calls[-1].compared <= 0.25 * n * (n - 1) / 2
