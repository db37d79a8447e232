"""Scalar text expressions, cleaning and style on edge rows."""
from __future__ import annotations

import hashlib
import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from credlake.config import CleaningConfig
from credlake.functions import text as tx
from credlake.functions.cleaning import STOPWORDS
from credlake.functions.style import with_style
from credlake.operators import corpus


def apply(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column.alias("x")).collect()]


def test_label_coercion(spark):
    cases = {
        "1": 1, "0": 0, "1.0": 1, "0.0": 0, " fake ": 1, "TRUE": 0, "unreliable": 1, "Reliable": 0, "false": 1,
        "2": None, "nan": None, "1d": None, "": None, "maybe": None, "1e0": 1, "-0": 0, "REAL": 0, None: None,
    }
    assert apply(spark, list(cases), "v string", tx.coerce_label(F.col("v"))) == list(cases.values())


def test_numeric_and_boolean_labels(spark):
    assert apply(spark, [1.0, 0.0, 0.5, None], "v double", tx.coerce_label(F.col("v"))) == [1, 0, None, None]
    assert apply(spark, [True, False], "v boolean", tx.coerce_label(F.col("v"))) == [0, 1]


def test_combine_title_text(spark):
    rows = [("A", "b"), ("A", ""), ("", "b"), (None, " b "), (" ", None), (" A\t", "\nb ")]
    got = apply(spark, rows, "t string, x string", tx.combine_title_text(F.col("t"), F.col("x")))
    assert got == ["A. b", "A", "b", "b", "", "A. b"]


def test_input_type_thresholds(spark):
    rows = [
        ("https://example.com", None), (" ".join(["w"] * 100), None), (" ".join(["w"] * 101), None),
        ("one two three four five", None), ("x", "http://a.org/p?q=1"), ("x", "not a url"), ("", None),
    ]
    got = apply(spark, rows, "t string, u string", tx.detect_input_type(F.col("t"), F.col("u")))
    assert got == ["url", "claim", "article", "claim", "url", "claim", "claim"]


def test_url_predicate(spark):
    good = ["https://example.com/article", "http://test.org/path?query=1", "HTTP://LOCALHOST:80", "http://127.0.0.1/x", "https://a.b-c.museum"]
    bad = ["not a url", "example.com", "ftp://example.com", "http://example.toolongtld", "http://a b.com", "https://ex.com/a b"]
    assert apply(spark, good + bad, "u string", tx.is_url(F.col("u"))) == [True] * len(good) + [False] * len(bad)


def test_confidence_levels(spark):
    cases = [(0.85, "High"), (0.849999, "Medium"), (0.65, "Medium"), (0.64, "Low"), (float("nan"), "Unknown"), (None, "Unknown")]
    assert apply(spark, [c for c, _ in cases], "c double", tx.confidence_level(F.col("c"))) == [e for _, e in cases]


def test_safe_preview(spark):
    long = "line one\n" + "é" * 50
    digest = hashlib.sha256(long.encode()).hexdigest()[:10]
    got = apply(spark, [long, "", None, "ab"], "t string", tx.safe_preview(F.col("t")))
    head = long[:40].replace("\n", " ")
    assert got[0] == f"'{head}...' (len=59, sha256={digest})"
    assert got[1:3] == ["<empty>", "<empty>"]
    assert got[3].startswith("'ab' (len=2")


def test_truncate_counts_code_points(spark):
    text = "\U0001f600" * 50001
    assert apply(spark, [text], "t string", F.length(tx.truncate(F.col("t")))) == [50000]


NASTY = [
    None, "", "   ", "\t\n", "Café naïve ﬁne", "ＦＵＬＬ　ｗｉｄｔｈ", "éclair café", "A B C\x1cD", "&lt;b&gt;bold&lt;/b&gt; &amp;amp; x",
    "&ampcopy &nbsp;&copy;2020 &#233;t&eacute;", "<p class='x'>Hello <b>World</b></p>", "see https://a.b/c?d=e&f now www.x.y/z. end",
    "mail bob.smith+tag@mail.example.co.uk, ok", "élan@site.org x@y.z", "a@b", "the can't won't I'll we've don't re", "x1 2y 33 4",
    "WOW!!! Is this real? Yes!!", "½ cup ② K Ⅷ ﷺ", "\U0001f600 emoji text", "AT&T R&D &T", "<unclosed tag http", "İstanbul straße ΣΑΣ",
    "..." * 50 + "a@b.c" + "..." * 50, "日本語 テスト", "a < b > c", "한국어 각 test",
]


def brute_clean(text, cfg=CleaningConfig()):
    """What cleaning must give, by plain Python."""
    if not text:
        return ""
    out = html.unescape(unicodedata.normalize("NFKC", text))
    for on, pattern in (
        (cfg.remove_html, r"<[^>]+>"),
        (cfg.remove_urls, r"https?://\S+|www\.\S+"),
        (cfg.remove_emails, r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ):
        out = re.sub(pattern, " ", out) if on else out
    out = out.lower() if cfg.lowercase else out
    out = re.sub(r"[^a-z0-9\s]", " ", out) if cfg.strip_non_alphanumeric else out
    words = [w for w in out.split() if not (cfg.remove_stopwords and w in STOPWORDS)]
    return " ".join(w for w in words if len(w) >= 2)


def clean(spark, texts, cfg=CleaningConfig()):
    from credlake.config import Settings

    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    return [r["clean_text"] for r in corpus.with_clean_text(df, Settings(cleaning=cfg)).orderBy("i").collect()]


def test_clean_text_matches_plain_python(spark):
    got = clean(spark, NASTY)
    assert got == [brute_clean(t) for t in NASTY]


@pytest.mark.parametrize(
    "cfg",
    [
        CleaningConfig(remove_stopwords=False),
        CleaningConfig(remove_html=False, remove_urls=False, remove_emails=False),
        CleaningConfig(lowercase=False),
        CleaningConfig(strip_non_alphanumeric=False),
    ],
)
def test_clean_text_switches(spark, cfg):
    assert clean(spark, NASTY, cfg) == [brute_clean(t, cfg) for t in NASTY]


def test_style_counts(spark):
    df = spark.createDataFrame([(0, "WOW!!! Is this real? Yes!!"), (1, " "), (2, None), (3, "1234 !?"), (4, "ÀB c d www.x.y")], "i int, content string")
    rows = {r["i"]: r for r in with_style(df).collect()}
    first = rows[0]
    assert (first["word_count"], first["exclamation_count"], first["question_count"], first["sentence_count"]) == (5.0, 5.0, 1.0, 3.0)
    assert (first["char_count"], first["punctuation_count"], first["avg_word_length"]) == (26.0, 6.0, 4.4)
    assert first["uppercase_ratio"] == round(5 / 16, 4)
    for blank in (1, 2):
        assert all(rows[blank][n] == 0.0 for n in rows[blank].asDict() if n not in ("i", "content"))
    assert rows[3]["uppercase_ratio"] == 0.0
    assert (rows[4]["word_count"], rows[4]["url_count"]) == (4.0, 1.0)
    assert rows[4]["uppercase_ratio"] == round(2 / 9, 4)


def test_input_types_shuffle_no_text(spark, tmp_path):
    """Documents and pages are judged before the joins: no join carries a text or a URL."""
    from credlake.workload import QUERIES

    spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 5, 6, 7, 10, 30, None)], "event_id long").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01' ts", "1L user_id", "'view' event_type", "1D value", "'' props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    texts = [(0, "http://a.org " + "word " * 120), (1, "six words stand in this text"), (2, None)]
    spark.createDataFrame([(*t, "en", "s", 1) for t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(0, "https://b.org/x", ""), (1, "no url", ""), (2, None, "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = QUERIES["input_types"](spark, str(tmp_path))
    assert {r["event_id"]: r["input_type"] for r in df.collect()} == {
        0: "url", 1: "claim", 2: "claim", 3: "article", 5: "claim", 6: "article", 7: "claim", 10: "claim", 30: "url"
    }
    plan, inputs = [df._jdf.queryExecution().optimizedPlan()], []
    while plan:
        node = plan.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            inputs += [c.output().apply(i).name() for c in children for i in range(c.output().size())]
        plan += children
    assert inputs and not {"text", "url"} & set(inputs)


def test_term_statistics_emit_a_term_once(spark):
    """One row per occurrence carries both counts; there is no second set of distinct terms."""
    from credlake.operators import vectorize

    rows = [(["b", "a", None, "a", None],), (None,), ([],), (["a"],)]
    stats = vectorize.term_statistics(spark.createDataFrame(rows, "terms array<string>"))
    assert sorted(tuple(r) for r in stats.collect()) == [("a", 3, 2), ("b", 1, 1)]
    assert "array_distinct" not in stats._jdf.queryExecution().optimizedPlan().toString()
