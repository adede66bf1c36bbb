"""Registered queries of the corpus engine, and DuckDB SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import metrics as M
from quillstack.functions import text as T
from quillstack.operators import corpus as C
from quillstack.operators import geometry as G
from quillstack.operators import usage as U
from quillstack.operators.numbering import number_within
from quillstack.plans import standins as S
from quillstack.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL over the stand-in relations."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {S.SQL.strip()}\n{sql.strip()}"
        return f

    return register


def relations(spark: SparkSession, sf_dir: str):
    return S.lines(spark, sf_dir), S.predictions(spark, sf_dir), S.corrections(spark, sf_dir)


LISTING = """SELECT l.id AS line_id, l.page_id, l.idx, coalesce((SELECT p.text FROM predictions p WHERE p.line_id = l.id ORDER BY p.id DESC LIMIT 1), '') AS prediction,
  c.text AS correction, c.kind, c.note, c.text IS NOT NULL AS reviewed,
  CASE WHEN length(c.text) > 0 THEN c.text ELSE coalesce((SELECT p.text FROM predictions p WHERE p.line_id = l.id ORDER BY p.id DESC LIMIT 1), '') END AS shown
  FROM lines l LEFT JOIN corrections c ON c.line_id = l.id"""
COLUMNS = ("line_id", "page_id", "idx", "prediction", "correction", "kind", "note", "reviewed", "shown")


@query(LISTING)
def review_lines(spark, sf_dir):
    return C.review_lines(*relations(spark, sf_dir)).select(*COLUMNS).orderBy("page_id", "idx")


@query(LISTING + " WHERE l.page_id = 3")
def page_lines(spark, sf_dir):
    return C.review_lines(*relations(spark, sf_dir)).where("page_id = 3").select(*COLUMNS).orderBy("idx")


@query(LISTING + " WHERE l.id = 42")
def line_lookup(spark, sf_dir):
    return C.review_lines(*relations(spark, sf_dir)).where("line_id = 42").select(*COLUMNS)


@query("SELECT p.id, p.n_lines, (SELECT count(*) FROM lines l JOIN corrections c ON c.line_id = l.id WHERE l.page_id = p.id) AS reviewed FROM book p")
def pages_reviewed(spark, sf_dir):
    lines, _, fixed = relations(spark, sf_dir)
    return C.pages_reviewed(S.pages(spark, sf_dir), lines, fixed)


@query("""SELECT (SELECT count(*) FROM book) AS pages, (SELECT count(*) FROM lines) AS lines, count(*) AS reviewed, count(*) FILTER (WHERE kind = 'sic') AS sic,
  CAST(coalesce(sum(length(text) - length(replace(text, ' ', '')) + 1), 0) AS BIGINT) AS words, 10000 AS target_words,
  least(100.0, round(100 * coalesce(sum(length(text) - length(replace(text, ' ', '')) + 1), 0) / 10000, 1)) AS progress FROM corrections""")
def corpus_stats(spark, sf_dir):
    lines, _, fixed = relations(spark, sf_dir)
    return C.corpus_stats(S.pages(spark, sf_dir), lines, fixed)


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents")
def words_split_rule(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"))


@query("SELECT * FROM corrections WHERE kind = 'sic'")
def sic_corrections(spark, sf_dir):
    return S.corrections(spark, sf_dir).where("kind = 'sic'")


@query("SELECT l.page_id, count(c.line_id) AS done, count(*) AS lines FROM lines l LEFT JOIN corrections c ON c.line_id = l.id GROUP BY 1")
def page_done(spark, sf_dir):
    lines, _, fixed = relations(spark, sf_dir)
    return C.page_done(lines, fixed)


@query("SELECT l.page_id, coalesce(min(l.idx) FILTER (WHERE c.line_id IS NULL), min(l.idx)) AS cursor FROM lines l LEFT JOIN corrections c ON c.line_id = l.id GROUP BY 1")
def review_cursor(spark, sf_dir):
    lines, _, fixed = relations(spark, sf_dir)
    return C.review_cursor(lines, fixed)


@query(r"""SELECT coalesce(b.line_id, n.line_id) AS line_id, coalesce(b.id, n.first_seq) AS id, CASE WHEN n.line_id IS NULL THEN b.text ELSE n.text END AS text,
  CASE WHEN n.line_id IS NULL THEN b.kind ELSE n.kind END AS kind, CASE WHEN n.line_id IS NULL THEN b.note ELSE n.note END AS note
  FROM corrections b FULL JOIN (
    SELECT conv_id AS line_id, min(conv_id * 1000 + turn) AS first_seq, arg_max(regexp_replace(text, '^\s+|\s+$', '', 'g'), turn) AS text,
      arg_max(CASE WHEN role = 'user' THEN 'fix' ELSE 'confirm' END, turn) AS kind, max_by(struct_pack(n := CASE WHEN turn % 2 = 0 THEN NULL ELSE role END), turn).n AS note
    FROM conversations GROUP BY 1) n ON n.line_id = b.line_id""")
def upsert_corrections(spark, sf_dir):
    c = S.read(spark, sf_dir, "conversations")
    note = F.when(F.col("turn") % 2 == 0, "  ").otherwise(F.col("role"))
    changes = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("conv_id").alias("line_id"), "text", F.when(F.col("role") != "user", "confirm").alias("kind"), note.alias("note"))
    return C.upsert_corrections(S.corrections(spark, sf_dir), changes)


@query("""SELECT id, page_id, idx, label FROM (SELECT *, row_number() OVER (PARTITION BY page_id, idx ORDER BY id DESC) AS k FROM (
    SELECT id, page_id, idx, 'old' AS label FROM lines UNION ALL SELECT conv_id + 1000000000, l.page_id, l.idx, 'new' FROM (SELECT DISTINCT conv_id FROM conversations) v JOIN lines l ON l.id = v.conv_id)) WHERE k = 1""")
def replace_lines(spark, sf_dir):
    return _replaced(spark, sf_dir)[0]


@query("SELECT id, line_id, text FROM corrections WHERE line_id NOT IN (SELECT conv_id FROM conversations)")
def cascade_delete(spark, sf_dir):
    return C.cascade(S.corrections(spark, sf_dir), _replaced(spark, sf_dir)[1]).select("id", "line_id", "text")


def _replaced(spark, sf_dir):
    old = S.lines(spark, sf_dir).select("id", "page_id", "idx", F.lit("old").alias("label"))
    again = S.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    new = old.join(again, "id").select((F.col("id") + 1_000_000_000).alias("id"), "page_id", "idx", F.lit("new").alias("label"))
    return C.replace_lines(old, new)


@query("SELECT id, (SELECT count(*) FROM lines l WHERE l.page_id = p.id) AS n_lines FROM (SELECT id, 0 AS n_lines FROM book) p")
def page_line_counts(spark, sf_dir):
    return C.page_line_counts(S.pages(spark, sf_dir).withColumn("n_lines", F.lit(0)), S.lines(spark, sf_dir)).select("id", F.col("n_lines").cast("long").alias("n_lines"))


@query("SELECT conv_id AS line_id, turn AS id, text, role AS model FROM conversations UNION ALL SELECT doc_id, 1000, text, lang FROM documents")
def append_prediction(spark, sf_dir):
    new = S.read(spark, sf_dir, "documents").select(F.lit(1000).cast("long").alias("id"), F.col("doc_id").alias("line_id"), "text", F.col("lang").alias("model"))
    return S.predictions(spark, sf_dir).unionByName(new).select("line_id", "id", "text", "model")


@query("SELECT a.conv_id, a.k AS place, a.turn AS id, b.text FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') a JOIN (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role <> 'user') b ON a.conv_id = b.conv_id AND a.k = b.k")
def line_prediction_zip(spark, sf_dir):
    """Line ids with results by position, as far as the shorter list reaches."""
    c = S.read(spark, sf_dir, "conversations")
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))).alias("ids"), F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "text")))).alias("said"))
    n = F.least(F.size("ids"), F.size("said"))
    placed = lists.select("conv_id", F.posexplode(F.slice(F.arrays_zip("ids", "said"), F.lit(1), n)).alias("place", "x"))
    return placed.select("conv_id", (F.col("place") + 1).cast("long").alias("place"), F.col("x.ids.turn").alias("id"), F.col("x.said.text").alias("text"))


@query("SELECT id AS line_id, page_id, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS number FROM lines")
def line_numbers(spark, sf_dir):
    lines = S.lines(spark, sf_dir).select(F.col("id").alias("line_id"), "page_id", "idx")
    return number_within(lines, "page_id", "idx", name="number").select("line_id", "page_id", "number")


@query(r"""SELECT number, line_id, lpad(CAST(number AS VARCHAR), CAST(greatest(5, length(CAST(number AS VARCHAR))) AS INTEGER), '0') || '.png' AS file, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS label,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM (
  SELECT row_number() OVER (ORDER BY l.page_id, l.idx) AS number, l.id AS line_id, l.lang, l.text FROM corrections c JOIN lines l ON l.id = c.line_id) WHERE lang <> 'es'""")
def export_training(spark, sf_dir):
    return _export(spark, sf_dir)


@query(r"""SELECT count(*) AS lines, CAST(coalesce(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))), 0) AS BIGINT) AS words FROM corrections c JOIN lines l ON l.id = c.line_id WHERE lang <> 'es'""".replace("(text", "(l.text"))
def export_counts(spark, sf_dir):
    return _export(spark, sf_dir).agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("words"))


def _export(spark, sf_dir):
    lines = S.lines(spark, sf_dir)
    fixed = S.corrections(spark, sf_dir).select("line_id").join(lines.select(F.col("id").alias("line_id"), "text"), "line_id")
    rows = C.training_rows(lines, fixed, lines.where("lang <> 'es'").select("image_path"))
    return rows.withColumn("words", F.col("words").cast("long"))


@query("""SELECT id AS line_id, 'page' || lpad(CAST(page_id AS VARCHAR), CAST(greatest(5, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') || '.png' AS page_path, 'p' || lpad(CAST(page_id AS VARCHAR), CAST(greatest(5, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') || '_l' || lpad(CAST(idx AS VARCHAR), CAST(greatest(3, length(CAST(idx AS VARCHAR))) AS INTEGER), '0') || '.png' AS line_path,
  'p' || lpad(CAST(page_id AS VARCHAR), CAST(greatest(5, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') || '_l' || lpad(CAST(idx AS VARCHAR), CAST(greatest(3, length(CAST(idx AS VARCHAR))) AS INTEGER), '0') || '_ctx.png' AS context_path, CASE WHEN coalesce(context_image_path, '') = '' THEN image_path ELSE context_image_path END AS shown_path FROM lines""")
def asset_paths(spark, sf_dir):
    return C.image_shown(C.asset_paths(S.lines(spark, sf_dir))).select(F.col("id").alias("line_id"), "page_path", "line_path", "context_path", "shown_path")


LENIENT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[=\-–—]', ' ', 'g'), '[().,;:!?]', ' ', 'g'), '[יו]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
SPOILT = r"regexp_replace(regexp_replace(text, ' (a|is|en) ', ' [unreadable] [?] ', 'g'), ', ', '’ — ', 'g')"


def spoilt(c: str):
    """A text with every kind of marker and quote that normalisation is about."""
    return F.regexp_replace(F.regexp_replace(c, " (a|is|en) ", " [unreadable] [?] "), ", ", "’ — ")


@query(f"""SELECT doc_id, regexp_replace(text, '\\[([^\\]\\[]+?)\\?\\]', '\\1', 'g') AS unmarked, regexp_replace({SPOILT}, '\\[\\?\\]', '', 'g') AS no_gaps,
  regexp_replace({SPOILT}, '\\[unreadable\\]|\\[לא קריא\\]|\\[מחוק\\]|\\[crossed out\\]|\\[strikethrough\\]', ' ', 'g') AS readable, translate({SPOILT}, '״”“׳’‘־–—', '"{'""'}{"'''" * 2}---') AS unified,
  translate(translate(text, 'abcdeh', 'אבגדהם'), 'ךםןףץ', 'כמנפצ') AS folded, regexp_replace(translate(text, 'ab', chr(1465) || chr(1470)), '[\\x{{0591}}-\\x{{05C7}}]', '', 'g') AS unpointed FROM marked""")
def normalize_steps(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").select("doc_id", S.marked("text").alias("text"))
    return d.select(
        "doc_id",
        T.unmark(F.col("text")).alias("unmarked"),
        T.drop_gap_marks(spoilt("text")).alias("no_gaps"),
        T.drop_unreadable(spoilt("text")).alias("readable"),
        T.unify_marks(spoilt("text")).alias("unified"),
        T.fold_finals(S.hebrew("text")).alias("folded"),
        T.drop_points(F.translate("text", "ab", "ֹ־")).alias("unpointed"),
    )


@query()
def normalize_full(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").select("doc_id", S.marked("text").alias("text"))
    return d.select("doc_id", T.normalize(F.col("text")).alias("normalized"), T.normalize(F.col("text"), strip_punctuation=True).alias("bare"))


def folded_pairs(spark, sf_dir):
    p = S.pairs(spark, sf_dir)
    return p.select("doc_id", "item_id", S.ascii_only("hypothesis").alias("hypothesis"), S.ascii_only("reference").alias("reference"))


COLLAPSED = r"SELECT doc_id, regexp_replace(regexp_replace(hypothesis, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS h, regexp_replace(regexp_replace(reference, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS r FROM pairs"
VERDICT = "CASE WHEN cer <= 0.05 THEN 'excellent' WHEN cer <= 0.15 THEN 'good' WHEN cer <= 0.30 THEN 'medium' WHEN cer <= 0.60 THEN 'weak' ELSE 'failure' END"
CER = f"SELECT doc_id, levenshtein(h, r) / greatest(length(r), 1) AS cer, length(h) / greatest(length(r), 1) AS length_ratio, length(r) AS ref_chars, length(h) AS hyp_chars FROM ({COLLAPSED})"


@query(f"SELECT *, {VERDICT} AS verdict, CASE WHEN length_ratio < 0.7 THEN 'truncated' WHEN length_ratio > 1.3 THEN 'invented' END AS warning FROM ({CER})")
def cer(spark, sf_dir):
    p = folded_pairs(spark, sf_dir)
    s = M.score(F.col("hypothesis"), F.col("reference"))
    out = p.select("doc_id", *[s[c].alias(c) for c in ("cer", "length_ratio", "ref_chars", "hyp_chars")])
    return out.withColumns({"ref_chars": F.col("ref_chars").cast("long"), "hyp_chars": F.col("hyp_chars").cast("long"), "verdict": M.verdict(F.col("cer")), "warning": M.length_warning(F.col("length_ratio"))})


@query(f"SELECT doc_id, CASE WHEN length(b) = 0 THEN 0.0 ELSE levenshtein(a, b) / length(b) END AS cer_lenient FROM (SELECT doc_id, {LENIENT.format('h')} AS a, {LENIENT.format('r')} AS b FROM ({COLLAPSED}))")
def cer_lenient(spark, sf_dir):
    s = M.score(F.col("hypothesis"), F.col("reference"))
    return folded_pairs(spark, sf_dir).select("doc_id", s["cer_lenient"].alias("cer_lenient"))


@query()
def score_report(spark, sf_dir):
    """All measures over whole raw texts; word distances of whole documents are beyond quick SQL."""
    return M.score_pairs(S.pairs(spark, sf_dir)).drop("hypothesis", "reference")


@query(f"SELECT count(*) AS pairs, round(avg(cer), 9) AS mean_cer, count(*) FILTER (WHERE cer > 0.60) AS failures FROM ({CER})")
def eval_summary(spark, sf_dir):
    s = M.score(F.col("hypothesis"), F.col("reference"))
    scored = folded_pairs(spark, sf_dir).select(s["cer"].alias("cer"))
    return scored.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("cer"), 9).alias("mean_cer"), F.count_if(M.verdict(F.col("cer")) == M.WORST).alias("failures"))


WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
#: The table of edit distances row by row: what stands above and to the upper left first, then what stands to the left.
WER = rf"""SELECT conv_id, turn, c / greatest(len(b), 1) AS wer, greatest(len(b), 1) AS ref_words, len(a) AS hyp_words, uncertain_marked FROM (
  WITH RECURSIVE t AS MATERIALIZED (SELECT conv_id, turn, {WORDS.format(r"regexp_replace(hypothesis, '\[([^\]\[]+?)\?\]', '\1', 'g')")} AS a, {WORDS.format("reference")} AS b,
    CAST(len(regexp_extract_all(hypothesis, '\[([^\]\[]+?)\?\]')) AS BIGINT) AS uncertain_marked FROM turns),
  d(conv_id, turn, i, j, c) AS (SELECT conv_id, turn, CAST(0 AS BIGINT), j, j FROM (SELECT conv_id, turn, unnest(range(0, len(b) + 1)) AS j FROM t)
    UNION ALL SELECT conv_id, turn, i, j, j + min(x - j) OVER (PARTITION BY conv_id, turn ORDER BY j) FROM (
      SELECT d.conv_id, d.turn, d.i + 1 AS i, d.j, CASE WHEN d.j = 0 THEN d.i + 1
        ELSE least(d.c + 1, lag(d.c) OVER (PARTITION BY d.conv_id, d.turn ORDER BY d.j) + CASE WHEN t.a[d.i + 1] = t.b[d.j] THEN 0 ELSE 1 END) END AS x
      FROM d JOIN t ON t.conv_id = d.conv_id AND t.turn = d.turn WHERE d.i < len(t.a)))
  SELECT t.*, d.c FROM d JOIN t ON t.conv_id = d.conv_id AND t.turn = d.turn AND d.i = len(t.a) AND d.j = len(t.b))"""


@query(WER)
def wer(spark, sf_dir):
    """Word error rates of turns, normalised in full."""
    s = M.score_pairs(S.turn_pairs(spark, sf_dir))
    return s.select("conv_id", "turn", "wer", *[F.col(c).cast("long").alias(c) for c in ("ref_words", "hyp_words", "uncertain_marked")])


@query(f"SELECT count(*) AS pairs, round(avg(wer), 9) AS mean_wer, CAST(sum(uncertain_marked) AS BIGINT) AS uncertain_marked FROM ({WER})")
def eval_words(spark, sf_dir):
    """The macro mean of word error rates."""
    s = M.score_pairs(S.turn_pairs(spark, sf_dir))
    return s.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("wer"), 9).alias("mean_wer"), F.sum(F.col("uncertain_marked").cast("long")).alias("uncertain_marked"))


@query(r"SELECT doc_id, regexp_replace(translate(text, ',.;:!?—', ''), '\s+', '', 'g') AS skeleton FROM documents")
def skeleton(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", T.skeleton(F.col("text")).alias("skeleton"))


CHANGED = r"regexp_replace(regexp_replace(text, ' (and|et|que|und) ', ', \1 ', 'g'), 'tiong', 'tionk', 'g')"


@query(f"""SELECT doc_id, a = b AS accepted, CASE WHEN a <> b THEN coalesce(list_min(list_filter(range(0, least(length(a), length(b))), lambda i: substr(a, i + 1, 1) <> substr(b, i + 1, 1))), least(length(a), length(b))) END AS place,
  CAST(length(regexp_replace(changed, '[^,.;:!?—]', '', 'g')) AS BIGINT) - length(regexp_replace(text, '[^,.;:!?—]', '', 'g')) AS added
  FROM (SELECT *, regexp_replace(translate(text, ',.;:!?—', ''), '\\s+', '', 'g') AS a, regexp_replace(translate(changed, ',.;:!?—', ''), '\\s+', '', 'g') AS b FROM (SELECT doc_id, text, {CHANGED} AS changed FROM documents))""")
def verify_punctuation(spark, sf_dir):
    changed = F.regexp_replace(F.regexp_replace("text", " (and|et|que|und) ", ", $1 "), "tiong", "tionk")
    d = S.read(spark, sf_dir, "documents").select("doc_id", "text", changed.alias("changed")).withColumns({"a": T.skeleton(F.col("text")), "b": T.skeleton(F.col("changed"))})
    return d.select("doc_id", (F.col("a") == F.col("b")).alias("accepted"), T.first_difference(F.col("a"), F.col("b")).cast("long").alias("place"), T.marks_added(F.col("text"), F.col("changed")).cast("long").alias("added"))


SCRIPT = "CASE lang WHEN 'de' THEN translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', repeat('ש', 52)) WHEN 'fr' THEN translate(text, 'abcdeh', 'אבגדהם') WHEN 'es' THEN regexp_replace(text, '[a-zA-Z]', '1', 'g') ELSE text END"
TONGUE = r"CASE WHEN regexp_matches(t, '[\x{0590}-\x{05FF}]') AND regexp_matches(t, '[a-zA-Z]') THEN 'mixed' WHEN regexp_matches(t, '[\x{0590}-\x{05FF}]') THEN 'he' WHEN regexp_matches(t, '[a-zA-Z]') THEN 'en' ELSE 'unknown' END"


def scripts(spark, sf_dir):
    """Texts in Latin, Hebrew, both, and neither."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = F.when(F.col("lang") == "de", F.translate("text", letters, "ש" * 52)).when(F.col("lang") == "fr", S.hebrew("text")).when(F.col("lang") == "es", F.regexp_replace("text", "[a-zA-Z]", "1")).otherwise(F.col("text"))
    return S.read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))


@query(f"SELECT doc_id, {TONGUE} AS language FROM (SELECT doc_id, {SCRIPT} AS t FROM documents)")
def detect_language(spark, sf_dir):
    return scripts(spark, sf_dir).select("doc_id", T.language(F.col("t")).alias("language"))


PARAGRAPHS = r"SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(replace(t, '. ', '.' || chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM (SELECT doc_id, {0} AS t FROM documents)"


@query(f"""SELECT doc_id, i AS number, ps[i] AS paragraph, CASE {TONGUE} WHEN 'he' THEN 'rtl' WHEN 'en' THEN 'ltr' ELSE CASE WHEN regexp_matches(ps[i], '[\\x{{05D0}}-\\x{{05EA}}\\x{{FB1D}}-\\x{{FB4E}}]') THEN 'rtl' ELSE 'ltr' END END AS direction
  FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM ({PARAGRAPHS.format(SCRIPT)}))""")
def paragraph_direction(spark, sf_dir):
    split = T.paragraphs(F.replace("t", F.lit(". "), F.lit(".\n \n")))
    d = scripts(spark, sf_dir).select("doc_id", T.language(F.col("t")).alias("language"), F.posexplode(split).alias("i", "paragraph"))
    return d.select("doc_id", (F.col("i") + 1).cast("long").alias("number"), "paragraph", T.direction(F.col("paragraph"), F.col("language")).alias("direction"))


@query(r"""SELECT doc_id, list_aggregate(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[!?.،؟]') THEN
   CASE WHEN regexp_full_match(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[!?.،؟]+') THEN regexp_replace(x, '^\s+|\s+$', '', 'g')
   ELSE regexp_replace(regexp_extract(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^([!?.،؟]+)(.*)$', 2), '^\s+|\s+$', '', 'g') || regexp_extract(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^([!?.،؟]+)(.*)$', 1) END ELSE x END), 'string_agg', chr(10)) AS moved
  FROM (SELECT doc_id, replace(replace(text, chr(10), chr(10) || '!? '), ' the', chr(10) || '  .') AS t FROM documents)""")
def leading_punctuation(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit("\n"), F.lit("\n!? ")), F.lit(" the"), F.lit("\n  ."))
    return S.read(spark, sf_dir, "documents").select("doc_id", T.move_leading_marks(t).alias("moved"))


@query(r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run, run_text AS text, uncertain FROM (
   SELECT doc_id, 2 * i AS k, unnest_text AS run_text, false AS uncertain FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\[[^\]]+\?\]')) AS unnest_text, generate_subscripts(regexp_split_to_array(text, '\[[^\]]+\?\]'), 1) AS i FROM marked)
   UNION ALL SELECT doc_id, 2 * i + 1, m, true FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[[^\]]+\?\]')) AS m, generate_subscripts(regexp_extract_all(text, '\[[^\]]+\?\]'), 1) AS i FROM marked)) WHERE run_text <> ''""")
def marker_runs(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.runs(S.marked("text"))).alias("run", "r"))
    return d.select("doc_id", (F.col("run") + 1).cast("long").alias("run"), "r.text", "r.uncertain")


@query(r"SELECT doc_id, list_aggregate(regexp_extract_all(text, '\[([^\]]+)\?\]', 1), 'string_agg', '|') AS words, len(regexp_extract_all(text, '\[([^\]]+)\?\]')) AS n FROM marked")
def uncertain_words(spark, sf_dir):
    found = T.uncertain_words(S.marked("text"))
    return S.read(spark, sf_dir, "documents").select("doc_id", F.when(F.size(found) > 0, F.array_join(found, "|")).alias("words"), F.size(found).cast("long").alias("n"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(' ' || (doc_id % 30) || CASE WHEN doc_id % 3 = 0 THEN '. ' WHEN doc_id % 3 = 1 THEN ') ' ELSE ' ' END || text, '^\s+|\s+$', '', 'g'), '^\s*(?:\d+[.):]\s*)?', ''), '^\s+|\s+$', '', 'g') AS text FROM documents")
def strip_line_numbers(spark, sf_dir):
    sign = F.when(F.col("doc_id") % 3 == 0, ". ").when(F.col("doc_id") % 3 == 1, ") ").otherwise(" ")
    t = F.concat(F.lit(" "), (F.col("doc_id") % 30).cast("string"), sign, F.col("text"))
    return S.read(spark, sf_dir, "documents").select("doc_id", T.strip_line_number(t).alias("text"))


MESSAGE = "CASE event_id % 8 WHEN 0 THEN 'x blockByNetFree //netfree.link/block/#' || event_id || ' y' WHEN 1 THEN 'HTTP 418 Blocked' WHEN 2 THEN 'code 429 ' || event_type WHEN 3 THEN 'api_key bad' WHEN 4 THEN 'got 403' WHEN 5 THEN '404 model' ELSE coalesce(event_type, '') || ' ' || coalesce(props, '') END"


@query(f"""SELECT event_id, CASE WHEN contains(m, 'blockByNetFree') OR contains(m, 'netfree.link') THEN '{T.BLOCKED}' WHEN contains(m, '418') AND contains(lower(m), 'block') THEN '{T.FILTERED}' WHEN contains(m, '429') THEN '{T.QUOTA}'
  WHEN contains(m, '401') OR contains(m, '403') OR contains(upper(m), 'API_KEY') THEN '{T.KEY}' WHEN contains(m, '404') THEN '{T.MISSING}' ELSE substr(m, 1, 200) END AS label,
  'https:' || nullif(regexp_extract(m, '(//netfree\\.link/block/#[^''"}}\\s]+)', 1), '') AS url FROM (SELECT event_id, {MESSAGE} AS m FROM events)""")
def error_labels(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    m = F.expr(MESSAGE)
    return e.select("event_id", m.alias("m")).select("event_id", T.error_label(F.col("m")).alias("label"), T.block_url(F.col("m")).alias("url"))


@query("""SELECT event_id, contains(upper(reason), 'MAX_TOKENS') AS truncated, length(coalesce(props, '')) > 0 AS success, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS INT), 0) AS tokens
  FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'finish_max_tokens' ELSE event_type END AS reason FROM events)""")
def status_flags(spark, sf_dir):
    reason = F.when(F.col("event_id") % 5 == 0, "finish_max_tokens").otherwise(F.col("event_type"))
    tokens = F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string"))
    return S.read(spark, sf_dir, "events").select("event_id", T.truncated(reason).alias("truncated"), (F.length(F.coalesce("props", F.lit(""))) > 0).alias("success"), T.count_or_zero(tokens).alias("tokens"))


@query("""SELECT i AS input_tokens, o AS output_tokens, t AS thinking_tokens, i / 1e6 * 2.0 AS cost_input_usd, o / 1e6 * 12.0 AS cost_output_usd, i / 1e6 * 2.0 + o / 1e6 * 12.0 AS cost_total_usd,
  CASE WHEN n = 0 THEN 0.0 ELSE (i / 1e6 * 2.0 + o / 1e6 * 12.0) / n END AS cost_per_page_usd FROM (
  SELECT CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS i, CAST(coalesce(sum(output_tokens + thinking_tokens), 0) AS BIGINT) AS o, CAST(coalesce(sum(thinking_tokens), 0) AS BIGINT) AS t, count(*) AS n FROM results)""")
def cost_report(spark, sf_dir):
    return U.cost_report(S.results(spark, sf_dir))


@query("""SELECT l_orderkey AS page_number, string_agg(l_returnflag || l_linenumber, chr(10) ORDER BY l_linenumber, l_returnflag || l_linenumber) FILTER (WHERE l_linestatus = 'O') AS text, CAST(sum(l_partkey) AS BIGINT) AS input_tokens,
  CAST(sum(l_suppkey + l_linenumber) AS BIGINT) AS output_tokens, CAST(sum(l_linenumber) AS BIGINT) AS thinking_tokens, CAST(sum(l_linenumber * 10) AS BIGINT) AS ms, count(*) FILTER (WHERE l_linestatus = 'O') AS ok_count FROM lineitem GROUP BY 1""".replace("string_agg(", "coalesce(string_agg(").replace("FILTER (WHERE l_linestatus = 'O') AS text", "FILTER (WHERE l_linestatus = 'O'), '') AS text"))
def page_rollup(spark, sf_dir):
    li = S.read(spark, sf_dir, "lineitem")
    ok = F.col("l_linestatus") == "O"
    rows = li.select(F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("index"), F.when(ok, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).otherwise(" ").alias("text"), ok.alias("success"), F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), F.col("l_linenumber").cast("long").alias("thinking_tokens"), (F.col("l_linenumber") * 10).alias("ms"))
    return U.page_rollup(rows)


@query("""SELECT count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed, coalesce(string_agg(CASE WHEN truncated THEN CAST(page_number AS VARCHAR) END, ',' ORDER BY page_number), '') AS truncated_pages,
  CAST(coalesce(sum(n_uncertain), 0) AS BIGINT) AS uncertain, coalesce(sum(api_call_ms), 0) / 1000 AS seconds FROM results""")
def run_summary(spark, sf_dir):
    return U.run_summary(S.results(spark, sf_dir))


@query("SELECT count(*) AS pages, count(*) FILTER (WHERE NOT success) AS failed, CAST(coalesce(sum(n_uncertain), 0) AS BIGINT) AS uncertain, printf('%.1f', coalesce(sum(api_call_ms), 0) / 1000) AS seconds FROM results")
def document_summary(spark, sf_dir):
    return U.document_summary(S.results(spark, sf_dir))


@query(r"SELECT page_number, n_uncertain FROM results WHERE success AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def punctuation_input(spark, sf_dir):
    return U.punctuated(S.results(spark, sf_dir)).select("page_number", F.col("n_uncertain").cast("long").alias("n_uncertain"))


@query(r"SELECT count(*) FILTER (WHERE regexp_replace(translate(text, ',.;:!?—', ''), '\s+', '', 'g') <> '') AS ok_count FROM results WHERE success AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def punctuated_ok(spark, sf_dir):
    return U.punctuated(S.results(spark, sf_dir)).agg(F.count_if(T.skeleton(F.col("text")) != "").alias("ok_count"))


@query("SELECT page_number, '### עמוד ' || page_number || chr(10) || text AS block FROM results")
def diplomatic_dump(spark, sf_dir):
    return U.diplomatic_dump(S.results(spark, sf_dir))


@query("SELECT d.doc_id, b.text AS transcript FROM documents d JOIN benchmark b ON 'img/' || d.doc_id = 'img/' || b.item_id WHERE trim(b.text) <> '' ORDER BY 'img/' || d.doc_id || '.png' LIMIT 3")
def fewshot_pairs(spark, sf_dir):
    images = S.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    texts = S.read(spark, sf_dir, "benchmark").select(F.concat(F.lit("img/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return files.few_shot(images, texts, 3).select("doc_id", F.col("text").alias("transcript"))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS name, d.doc_id, b.text AS reference FROM documents d JOIN benchmark b ON d.doc_id = b.item_id WHERE trim(b.text) <> ''")
def eval_pairs(spark, sf_dir):
    images = S.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    texts = S.read(spark, sf_dir, "benchmark").select(F.concat(F.lit("img/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return files.pairs_by_stem(images, texts).select(F.col("stem").alias("name"), "doc_id", F.col("text").alias("reference"))


@query(r"SELECT doc_id, coalesce(list_aggregate(list_filter(string_split(replace(text, chr(10), chr(10) || '# '), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '' AND NOT regexp_matches(x, '^\s*#')), 'string_agg', chr(10)), '') AS profile FROM documents")
def read_profile(spark, sf_dir):
    t = F.replace("text", F.lit("\n"), F.lit("\n# "))
    return S.read(spark, sf_dir, "documents").select("doc_id", files.profile(t).alias("profile"))


@query("""SELECT p_partkey, CASE WHEN greatest(w, h) > 4096 THEN CAST(trunc(w * (4096.0::DOUBLE / greatest(w, h))) AS INT) ELSE w END AS width, CASE WHEN greatest(w, h) > 4096 THEN CAST(trunc(h * (4096.0::DOUBLE / greatest(w, h))) AS INT) ELSE h END AS height
  FROM (SELECT p_partkey, CAST(p_partkey * 7 % 9000 + 1 AS INT) AS w, CAST(p_partkey * 13 % 7000 + 1 AS INT) AS h FROM part)""")
def size_cap(spark, sf_dir):
    p = S.read(spark, sf_dir, "part")
    w, h = (F.col("p_partkey") * 7 % 9000 + 1).cast("int"), (F.col("p_partkey") * 13 % 7000 + 1).cast("int")
    return p.select("p_partkey", T.size_cap(w, h).alias("s")).select("p_partkey", "s.*")


@query("SELECT o_orderkey, (o_custkey + 40) - o_custkey AS width, o_orderkey % 100 + 5 AS height, (o_orderkey % 30) * 2 AS half_points FROM orders WHERE (o_orderkey % 100 + 5) > 0")
def box_dims(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("x0"), F.lit(0).alias("y0"), (F.col("o_custkey") + 40).alias("x1"), (F.col("o_orderkey") % 100 + 5).alias("y1")).alias("box"))
    sized = o.select("o_orderkey", (F.col("box.x1") - F.col("box.x0")).alias("width"), (F.col("box.y1") - F.col("box.y0")).alias("height"), (F.col("o_orderkey") % 30 * 2).alias("half_points"))
    return sized.where("height > 0")


OPTION = "CASE event_id % 6 WHEN 0 THEN ' TRUE ' WHEN 1 THEN '1' WHEN 2 THEN 'on' WHEN 3 THEN 'no' WHEN 4 THEN ' yes' ELSE event_type END"


@query(f"""SELECT event_id, lower(trim({OPTION})) IN ('1', 'true', 'yes', 'on') AS flag, coalesce(nullif(event_id % 4, 0), 300) AS dpi, contains(lower(event_type || CASE WHEN event_id % 2 = 0 THEN '-IMAGE' ELSE '' END), 'image') AS warns,
  lower(regexp_extract('a.B.' || event_type, '\\.[^.]*$')) IN ('.click', '.view', '.purchase') AS known FROM events""")
def option_parse(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    model = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "-IMAGE").otherwise(""))
    suffix = F.lower(F.regexp_extract(F.concat(F.lit("a.B."), "event_type"), r"(\.[^.]*)$", 1))
    return e.select("event_id", T.flag(F.expr(OPTION)).alias("flag"), F.coalesce(F.nullif(F.col("event_id") % 4, F.lit(0)), F.lit(300)).alias("dpi"), F.lower(model).contains("image").alias("warns"), suffix.isin(".click", ".view", ".purchase").alias("known"))


@query("SELECT c.conv_id, count(*) AS lines FROM conversations c GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'user') > 0")
def pages_with_lines(spark, sf_dir):
    lists = S.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).alias("detected"), F.count(F.lit(1)).alias("lines"))
    return lists.where(F.size("detected") > 0).select("conv_id", "lines")


@query(r"SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'sic' WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = regexp_replace(CASE WHEN turn % 2 = 0 THEN text || ' ' ELSE text || '.' END, '^\s+|\s+$', '', 'g') THEN 'confirm' ELSE 'fix' END AS kind FROM conversations")
def inferred_kinds(spark, sf_dir):
    new = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" "))).otherwise(F.concat("text", F.lit(".")))
    return S.read(spark, sf_dir, "conversations").select("conv_id", "turn", C.inferred_kind(new, F.col("text"), F.col("turn") % 5 == 0).alias("kind"))


SEGMENTS = "l_orderkey AS page_id, l_partkey % 97 AS x1, l_suppkey % 89 AS y1, l_partkey % 31 AS x2, l_linenumber * 13 AS y2"


@query(f"""SELECT page_id, count(*) FILTER (WHERE a < 20 OR a > 160) AS horizontal, count(*) FILTER (WHERE a > 70 AND a < 110) AS vertical
  FROM (SELECT page_id, abs(degrees(atan2(y2 - y1, x2 - x1))) % 180 AS a FROM (SELECT {SEGMENTS} FROM lineitem)) GROUP BY 1""")
def orientation_votes(spark, sf_dir):
    return G.orientation_votes(S.read(spark, sf_dir, "lineitem").selectExpr(*SEGMENTS.split(", ")))


@query("""SELECT sheet_id, x[1] AS x1, y[1] AS y1, x[2] AS x2, y[2] AS y2, x[3] AS x3, y[3] AS y3, x[4] AS x4, y[4] AS y4 FROM (
  SELECT l_orderkey AS sheet_id, list_transform(p, lambda a: a.x) AS x, list_transform(p, lambda a: a.y) AS y FROM (
    SELECT l_orderkey, [list(q ORDER BY x + y, l_linenumber, x, y)[1], list(q ORDER BY y - x, l_linenumber, x, y)[1], list(q ORDER BY -x - y, l_linenumber, x, y)[1], list(q ORDER BY x - y, l_linenumber, x, y)[1]] AS p
    FROM (SELECT *, {'x': x, 'y': y} AS q FROM (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS x, l_suppkey % 100 AS y FROM lineitem)) GROUP BY 1))""")
def ordered_corners(spark, sf_dir):
    points = S.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS sheet_id", "l_linenumber AS place", "l_partkey % 100 AS x", "l_suppkey % 100 AS y")
    corner = lambda i, c: F.col("corners")[i][c].alias(f"{c}{i + 1}")
    return G.ordered_corners(points).select("sheet_id", *[corner(i, c) for i in range(4) for c in ("x", "y")])


@query("""SELECT doc_id, source || '_transcribed.docx' AS document, source || '_diplomatic.txt' AS diplomatic,
  source || '_line' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '.png' AS line_image FROM documents""")
def output_names(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents")
    return d.select("doc_id", *[c.alias(n) for n, c in G.output_names(F.col("source"), F.col("doc_id")).items()])
