"""Page extraction, stored answers, payloads, streaming jobs."""
from __future__ import annotations

import datetime as dt

from conftest import values
from pyspark.sql import functions as F

from credlake.functions import answers
from credlake.operators import linear, pages
from credlake.operators.vectorize import FeatureSpace
from credlake.plans import prediction
from credlake.sources.search_payloads import normalize_payloads
from credlake.streaming import jobs

LONG = "This paragraph is certainly longer than fifty characters"
PAGE = f"""<!DOCTYPE html><html><head><title> Plain &eacute; title </title>
<meta content="Shared &quot;title&quot;" property="og:title"><meta name='author' content='A. Writer'>
<meta property="article:published_time" content="2024-02-03T04:05:06Z"><style>p{{x}}</style>
<script>var s = "<p>{LONG}</p>";</script></head><body><p>short</p>
<p class="lead"> {LONG} <b> and bold </b> end&nbsp;</p><!-- <p>{LONG}</p> -->
<p>{LONG} one<p>{LONG} two &amp; three<div>not in paragraph {LONG}</div><pre>{LONG}</pre></body></html>"""


def test_article_extraction(spark):
    df = spark.createDataFrame([(1, "http://x", PAGE), (2, "http://y", "no markup"), (3, "http://z", "<p>" + "a" * 60)], "id int, url string, html string")
    rows = {r["id"]: r for r in pages.article_rows(df).collect()}
    first = rows[1]
    assert (first["title"], first["author"], first["date"]) == ('Shared "title"', "A. Writer", "2024-02-03T04:05:06Z")
    assert first["text"].split("\n\n") == [f"{LONG}and boldend", f"{LONG} one", f"{LONG} two & three"]
    assert (rows[2]["title"], rows[2]["text"]) == ("", "")
    assert rows[3]["text"] == "a" * 60


def test_title_without_meta_and_text_cap(spark):
    df = spark.createDataFrame([("u", f"<title>Plain &eacute;</title><p>{'b' * 200}</p>")], "url string, html string")
    row = pages.article_rows(df, max_chars=100).first()
    assert (row["title"], row["text"]) == ("Plain é", "b" * 100)


def test_media_rows(spark):
    df = spark.createDataFrame([(1, [f"i{n}" for n in range(8)]), (2, [])], "request_id long, images array<string>")
    assert values(pages.media_rows(df), "request_id", "position", "url", "is_reused") == [(1, n, f"i{n}", False) for n in range(5)]


def test_claim_lists(spark):
    cases = ['[{"text": "a"}, {"text": "b", "numerical_values": 5}]', '{"claims": [{"text": "c"}]}', "not json", '[{"text": "a"', "[]", '{"claims": 3}', None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, a string")
    got = df.select("i", F.inline(answers.claim_list(F.col("a"), F.lit("whole"))))
    texts = {}
    for i, text, number in values(got.orderBy("i"), "i", "text", "numerical_values"):
        texts.setdefault(i, []).append((text, number))
    assert texts[0] == [("a", None), ("b", "5")] and texts[1] == [("c", None)]
    assert all(texts[i] == [("whole", None)] for i in range(2, 7))


def test_malformed_answers_give_defaults(spark):
    df = spark.createDataFrame([("oops",), ('{"assessment": "supports", "confidence": 0.7}',)], "a string")
    rows = [r["c"] for r in df.select(answers.parse_answer(F.col("a"), "comparison").alias("c")).collect()]
    assert (rows[0]["assessment"], rows[0]["confidence"], rows[0]["key_factors"]) == ("neutral", 0.5, [])
    assert (rows[1]["assessment"], rows[1]["confidence"]) == ("supports", 0.7)


def test_search_payload_shapes(spark):
    rows = [
        ("tavily", '{"results": [{"url": "u1", "title": "t", "content": "c", "score": 0.4, "published_date": "d"}]}'),
        ("brave", '{"web": {"results": [{"url": "u2", "description": "c2"}]}}'),
        ("serpapi", '{"organic_results": [{"link": "u3", "snippet": "c3", "date": "x"}]}'),
        ("tavily", "broken"), ("brave", "{}"),
    ]
    df = spark.createDataFrame(rows, "provider string, payload string")
    got = sorted(values(normalize_payloads(df), "url", "title", "snippet", "score", "published_date", "rank"))
    assert got == [("u1", "t", "c", 0.4, "d", 1), ("u2", "", "c2", 0.0, None, 1), ("u3", "", "c3", 1.0, "x", 1)]


def drain(stream, spark, folder):
    jobs.write_parquet(stream, f"{folder}/out", f"{folder}/cp", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_streamed_scores_equal_batch(spark, tmp_path):
    space = FeatureSpace(["bad", "good"], [1, 1], [1.0, 2.0], 2, [(0.0, 10.0)] * 9)
    model = linear.LinearModel("LogisticRegression", [2.0, -2.0] + [0.1] * 9, -0.1)
    df = spark.createDataFrame([(1, "bad bad news"), (2, "good news"), (3, " ")], "id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.score_articles(jobs.read_files(spark, str(tmp_path / "in"), df.schema), space, model)
    got = drain(stream, spark, tmp_path)
    assert sorted(got.collect()) == sorted(prediction.predict_batch(df, space, model).collect())


def test_long_texts_are_read_whole_by_default(spark, tmp_path):
    space = FeatureSpace(["bad", "good"], [1, 1], [1.0, 2.0], 2, [(0.0, 10.0)] * 9)
    model = linear.LinearModel("LogisticRegression", [2.0, -2.0] + [0.0] * 9, -0.1)
    df = spark.createDataFrame([(1, "good " + "filler " * 8000 + "bad " * 50)], "id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    assert prediction.predict_batch(df, space, model).first()["prediction"] == "FAKE"
    assert prediction.predict_explained(df, space, model).first()["prediction"] == "FAKE"
    assert prediction.predict_batch(df, space, model, max_chars=50_000).first()["prediction"] == "REAL"
    stream = jobs.score_articles(jobs.read_files(spark, str(tmp_path / "in"), df.schema), space, model)
    assert drain(stream, spark, tmp_path).first()["prediction"] == "FAKE"
    html = "<p>" + "x" * 60_000 + "</p><!--" + "c" * 500_000 + "--><p>" + "y" * 60 + "</p>"
    page = spark.createDataFrame([("u", html)], "url string, html string")
    assert pages.article_rows(page).first()["text"] == "x" * 60_000 + "\n\n" + "y" * 60
    assert pages.article_rows(page, max_chars=50_000).first()["text"] == "x" * 50_000


def test_first_seen_and_windows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=10 * n), f"u{n % 4}", "verified" if n % 3 else "false") for n in range(60)] + [(start, "", "false")]
    df = spark.createDataFrame(rows, "ts timestamp, url string, verdict string")
    df.write.parquet(str(tmp_path / "in"))
    seen = drain(jobs.first_seen(jobs.read_files(spark, str(tmp_path / "in"), df.schema)), spark, tmp_path / "a")
    assert sorted(values(seen, "url")) == [("u0",), ("u1",), ("u2",), ("u3",)]
    stream = jobs.verdict_windows(jobs.read_files(spark, str(tmp_path / "in"), df.schema), time="ts")
    counts = values(drain(stream, spark, tmp_path / "b"), "window_start", "verdict", "n_checks")
    closed = start + dt.timedelta(minutes=590) - dt.timedelta(hours=1)
    batch = df.groupBy(F.window("ts", "1 hour").alias("w"), "verdict").count().filter(F.col("w.end") <= F.lit(closed))
    assert sorted(counts) == sorted(values(batch.select(F.col("w.start").alias("s"), "verdict", "count"), "s", "verdict", "count"))


def test_late_rows_and_repeated_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(n, start + dt.timedelta(minutes=10 * (n * 37 % 300)), f"u{n % 7}", "verified" if n % 3 else "false") for n in range(300)]
    rows += [(300, start, " ", "false"), (301, None, "u1", "false"), (302, None, "u9", "false"), (303, rows[3][1], rows[3][2], "false")]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, url string, verdict string")
    for n in range(4):  # every file holds rows days older than the last one's newest
        df.where(F.col("event_id") % 4 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, reduced, merged in (
        ("first", lambda d: jobs.first_rows(d, ties=("event_id",)), lambda d: jobs.first_rows(d, ties=("event_id",))),
        ("counts", lambda d: jobs.window_counts(d, time="ts"), jobs.window_totals),
    ):
        out = str(tmp_path / name)
        stream = jobs.read_files(spark, str(tmp_path / "in"), df.schema, max_files=1)
        jobs.write_batches(stream, reduced, out, f"{out}-cp", available_now=True).awaitTermination()
        read = lambda: sorted(merged(spark.read.parquet(out).drop("batch")).collect(), key=str)  # noqa: E731, B023
        assert read() == sorted(merged(reduced(df)).collect(), key=str)
        before = read()
        batches = spark.read.parquet(out)
        assert batches.select("batch").distinct().count() == 4
        files = sorted(r[0] for r in spark.read.parquet(str(tmp_path / "in")).select(F.input_file_name()).distinct().collect())
        assert len(files) == 4
        number, again = next((n, f) for n in range(4) for f in files if sorted(reduced(spark.read.parquet(f)).collect(), key=str) == sorted(batches.where(f"batch = {n}").drop("batch").collect(), key=str))
        jobs.batch_sink(reduced, out)(spark.read.parquet(again), number)
        assert read() == before
    first = {r["url"]: r["event_id"] for r in jobs.first_rows(df, ties=("event_id",)).collect()}
    by_url = {}
    for i, ts, url, _ in rows:
        if url.strip():
            by_url.setdefault(url, []).append((ts is None, ts or start, i))
    assert first == {u: min(found)[2] for u, found in by_url.items()}
    assert jobs.first_rows(df.limit(0)).count() == jobs.window_counts(df.limit(0), time="ts").count() == 0
