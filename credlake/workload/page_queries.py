"""Page extraction, files and streams."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from credlake.functions.cleaning import unescape
from credlake.operators import pages as pg
from credlake.operators.common import checkpoint_dir
from credlake.plans import verification as vp
from credlake.schemas import TRUTH_COLUMNS
from credlake.sources import news_files, store
from credlake.streaming import jobs
from credlake.workload import sql_views as q
from credlake.workload import views as v
from credlake.workload.model_queries import PREDICTED, articles_to_score, naive_bayes
from credlake.workload.registry import query
from credlake.workload.text_queries import _entities

META = (
    """'<meta property="og:title" content="Shared &amp; seen ' || page_id || '">', """
    """'<META content=''Ann Author'' name="author">', """
    """'<meta property="article:published_time" content="2024-05-0' || (page_id % 9 + 1) || '">', ''"""
)
HEADED = f"SELECT page_id, url, list_extract([{META}], page_id % 4 + 1) || html AS html FROM pages"


def _headed(spark, sf):
    """Pages with a meta tag of one kind put in front."""
    page = F.col("page_id")
    meta = (
        F.when(page % 4 == 0, F.concat(F.lit('<meta property="og:title" content="Shared &amp; seen '), page.cast("string"), F.lit('">')))
        .when(page % 4 == 1, "<META content='Ann Author' name=\"author\">")
        .when(page % 4 == 2, F.concat(F.lit('<meta property="article:published_time" content="2024-05-0'), (page % 9 + 1).cast("string"), F.lit('">')))
        .otherwise("")
    )
    return v.table(spark, sf, "pages").select("page_id", "url", F.concat(meta, "html").alias("html"))


@query(
    "page_heads",
    f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Shared & seen ' || page_id
                             ELSE {q.strip(_entities("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} END AS title,
               CASE WHEN page_id % 4 = 1 THEN 'Ann Author' ELSE '' END AS author,
               CASE WHEN page_id % 4 = 2 THEN '2024-05-0' || (page_id % 9 + 1) ELSE '' END AS date
        FROM pages""",
)
def page_heads(spark, sf):
    return pg.with_head_fields(_headed(spark, sf)).select("page_id", "title", "author", "date")


_BLOCKS = pg.PARAGRAPH_END.replace("'", "''")
MARKED = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{pg.HIDDEN}', '', 'g'), "
    f"'{pg.PARAGRAPH_START}', chr(1), 'g'), '{_BLOCKS}', chr(2), 'g'), '{pg.TAG}', chr(3), 'g')"
)
BODY = f"""
    SELECT page_id, url, html, substr(array_to_string(list_filter(list_transform(string_split({_entities('m')}, chr(1))[2:],
           lambda p: array_to_string(list_transform(string_split(split_part(p, chr(2), 1), chr(3)), lambda n: {q.strip('n')}), '')),
           lambda t: length(t) > 50), chr(10) || chr(10)), 1) AS body
    FROM (SELECT page_id, url, html, {MARKED} AS m FROM (SELECT page_id, url, html FROM pages))"""


@query(
    "article_rows",
    f"""SELECT page_id, url, {q.strip(_entities("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS title,
               length(body) AS n_chars, md5(body) AS text_md5, true AS success FROM ({BODY})""",
)
def article_rows(spark, sf):
    rows = pg.article_rows(v.table(spark, sf, "pages"))
    return rows.select(
        "page_id", "url", "title", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "success"
    )


@query(
    "media_rows",
    """SELECT page_id AS request_id, i AS position, url, md5(page_id || '|' || i) AS media_id, 'image' AS media_type, false AS is_reused FROM (
         SELECT page_id, unnest(links) AS url, unnest(range(len(links))) AS i FROM (
           SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1)[1:5] AS links FROM pages))""",
)
def media_rows(spark, sf):
    """Media rows of the links of each page, as if they were image URLs."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    rows = v.table(spark, sf, "pages").select(F.col("page_id").alias("request_id"), links.alias("images"))
    return pg.media_rows(rows)


@query(
    "page_verdicts",
    f"""SELECT p.page_id AS request_id, CASE WHEN p.page_id % 7 = 0 THEN 'failed' WHEN body = '' THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN p.page_id % 7 = 0 THEN 'The page took too long to load.' WHEN body = '' THEN 'No content extracted' END AS failure,
               CASE WHEN p.page_id % 7 = 0 OR body = '' THEN 'unverified' WHEN s + c = 0 THEN 'unverified' ELSE {q.bucketed('score', 1)} END AS verdict,
               CAST(round(CASE WHEN p.page_id % 7 = 0 OR body = '' THEN 0.0 WHEN s + c = 0 THEN 0.3 ELSE least(0.99, 0.5 + (s + c) * 0.05) END, 6) AS DOUBLE) AS confidence,
               CASE WHEN p.page_id % 7 = 0 OR body = '' THEN 'unknown' WHEN s + c = 0 THEN 'UNKNOWN' ELSE {q.bucketed('score', 2)} END AS evidence_strength
        FROM ({BODY}) p JOIN (
          SELECT *, greatest(0, least(100, 50 + 5 * s + 10 * pr - 8 * c - 2 * n)) AS score FROM (
            SELECT pages.page_id, count(*) FILTER (rel = 'supports' AND ok) AS s, count(*) FILTER (rel = 'contradicts' AND ok) AS c,
                   count(*) FILTER (rel = 'neutral' AND ok) AS n, count(*) FILTER (kind = 'primary') AS pr
            FROM pages LEFT JOIN (
              SELECT *, {q.source_type('host')} AS kind FROM (
                SELECT rank // 5 AS request_id, length(snippet) >= 20 AS ok, {q.relation('lower(title)')} AS rel, {q.domain('url')} AS host,
                       row_number() OVER (PARTITION BY rank // 5, url ORDER BY rank) AS copy_no FROM v_page_results) WHERE copy_no = 1) r
              ON r.request_id = pages.page_id GROUP BY 1)) k ON k.page_id = p.page_id""",
)
def page_verdicts(spark, sf):
    """Raw pages to verdicts: page p finds the results 5p to 5p + 4; some fetches failed."""
    page = F.col("page_id")
    raw = v.table(spark, sf, "pages").select(
        page.alias("request_id"),
        "url",
        "html",
        F.when(page % 7 == 0, "timeout").alias("error"),
        F.when(page % 7 == 0, "The page took too long to load.").alias("message"),
    )
    found = v.page_results(spark, sf).select(
        F.floor(F.col("rank") / 5).alias("request_id"), F.lit(0).alias("query_no"), "rank", "url", "title",
        "snippet", "published_date", "score",
    )
    return vp.verify_pages(raw, found).select(
        "request_id", "status", "failure", "verdict", F.round("confidence", 6).alias("confidence"), "evidence_strength"
    )


@query("decoded_titles", f"SELECT page_id, {_entities('t')} AS title FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)")
def decoded_titles(spark, sf):
    rows = v.table(spark, sf, "pages").select("page_id", v.page_title_text().alias("t"))
    return rows.select("page_id", unescape(F.col("t")).alias("title"))


# ---- files ------------------------------------------------------------------


@query(
    "news_file_scan",
    """SELECT label, count(*) AS n_rows, CAST(sum(length(title)) AS BIGINT) AS title_chars, CAST(sum(length(text)) AS BIGINT) AS text_chars
       FROM (SELECT title, text, CASE label WHEN 'FAKE' THEN 1 WHEN 'REAL' THEN 0 END AS label FROM v_news) GROUP BY label""",
)
def news_file_scan(spark, sf):
    """News written as CSV with other column names, read back by the file loader."""
    path = f"{checkpoint_dir(spark)}/news-{uuid.uuid4().hex}.csv"
    rows = v.news(spark, sf).select(
        F.col("title").alias("Headline"), F.col("text").alias("News-Text"), F.col("label").alias("Class")
    )
    store.write_csv(rows, path)
    back = news_files.read_single(spark, path)
    return back.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.length("title")).alias("title_chars"),
        F.sum(F.length("text")).alias("text_chars"),
    )


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


READ_NEWS = "SELECT md5(title) AS title_md5, md5(text) AS text_md5, label, count(*) AS n_rows FROM ({rows}) GROUP BY ALL"
CODED_NEWS = "SELECT coalesce(title, '') AS title, coalesce(text, '') AS text, CASE label WHEN 'FAKE' THEN 1 WHEN 'REAL' THEN 0 END AS label FROM v_news"


def _read_news(rows):
    return rows.groupBy(F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"), "label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("single_folder_scan", READ_NEWS.format(rows=CODED_NEWS))
def single_folder_scan(spark, sf):
    """A folder of many labelled files of two headers, found, read and put together by the loader."""
    folder, rows = _folder(spark, "many"), v.news(spark, sf)
    store.write_csv(rows.filter("doc_id % 2 = 0").select(F.col("title").alias("Headline"), F.col("text").alias("News Text"), F.col("label").alias("Class")), f"{folder}/first.csv")
    store.write_csv(rows.filter("doc_id % 2 = 1").select(F.col("label").alias("target"), F.col("text").alias("body"), F.col("title").alias("head")), f"{folder}/second.csv")
    return _read_news(news_files.read_news(spark, folder))


@query("paired_folder_scan", READ_NEWS.format(rows=CODED_NEWS + " WHERE label IS NOT NULL"))
def paired_folder_scan(spark, sf):
    """A folder with a table of FAKE and a table of REAL news, whose names give the label."""
    folder, rows = _folder(spark, "paired"), v.news(spark, sf)
    for name, label in (("Fake", "FAKE"), ("TRUE", "REAL")):
        store.write_csv(rows.filter(F.col("label") == label).select("title", "text"), f"{folder}/{name}.csv")
    return _read_news(news_files.read_news(spark, folder))


TRUTH = ["true", "mostly-true", "half-true", "barely-true", "false", "pants-fire"]


@query(
    "truth_label_scan",
    "SELECT md5(coalesce(text, '')) AS text_md5, CASE WHEN doc_id % 6 >= 3 THEN 1 ELSE 0 END AS label, count(*) AS n_rows FROM documents GROUP BY ALL",
)
def truth_label_scan(spark, sf):
    """Documents as statements of a headerless file with six truth labels."""
    path, doc = _folder(spark, "truth"), F.col("doc_id")
    rest = [F.lit("x").alias(c) for c in TRUTH_COLUMNS[3:]]
    rows = v.table(spark, sf, "documents").select(doc.alias("id"), v.pick(doc % 6, TRUTH).alias("label"), F.col("text").alias("statement"), *rest)
    rows.write.csv(path, sep="\t", header=False, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = news_files.read_truth_labels(spark, path)
    return back.groupBy(F.md5("text").alias("text_md5"), "label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("csv_report", "SELECT doc_id, lang, md5(coalesce(text, '')) AS text_md5 FROM documents")
def csv_report(spark, sf):
    """Documents through a CSV report: quotes, line ends and blanks come back as they were."""
    path = _folder(spark, "report-csv")
    store.write_csv(v.table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    back = spark.read.schema("doc_id long, lang string, text string").csv(
        path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return back.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("json_report", "SELECT doc_id, label IS NULL AS no_label, label, md5(title) AS title_md5, md5(text) AS text_md5 FROM v_news")
def json_report(spark, sf):
    """News through a JSON report: fields that are null are written as null."""
    path = _folder(spark, "report-json")
    store.write_json(v.news(spark, sf).select("doc_id", "label", "title", "text"), path)
    lines = spark.read.text(path).select("value", F.from_json("value", "doc_id long, label string, title string, text string").alias("r"))
    return lines.select(
        "r.doc_id", F.col("value").contains('"label":null').alias("no_label"), "r.label", F.md5("r.title").alias("title_md5"), F.md5("r.text").alias("text_md5")
    )


# ---- streams ----------------------------------------------------------------


def _drain(stream, spark):
    """Run a stream over what is there now and read its output."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    jobs.write_parquet(stream, f"{base}/out", f"{base}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _stream(spark, sf, name: str):
    return jobs.read_files(spark, f"{sf}/{name}*.parquet", v.table(spark, sf, name).schema)


@query("streamed_predictions", PREDICTED)
def streamed_predictions(spark, sf):
    """Articles arriving as files, scored by the batch plan."""
    _, space, model = naive_bayes(spark, sf)
    base = f"{checkpoint_dir(spark)}/articles-{uuid.uuid4().hex}"
    articles_to_score(spark, sf).write.parquet(base)
    arriving = jobs.read_files(spark, base, articles_to_score(spark, sf).schema)
    rows = _drain(jobs.score_articles(arriving, space, model), spark)
    return rows.select("doc_id", "prediction", "confidence", "confidence_level")


@query("streamed_first_seen", "SELECT DISTINCT 'https://feed.example/' || user_id AS url FROM events")
def streamed_first_seen(spark, sf):
    """Each feed URL once; which of its rows arrives first is not defined."""
    events = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("https://feed.example/"), F.col("user_id").cast("string")).alias("url"),
    )
    return _drain(jobs.first_seen(events, delay="60 days"), spark).select("url")


@query(
    "streamed_verdict_windows",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS verdict, count(*) AS n_checks
       FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
)
def streamed_verdict_windows(spark, sf):
    """Counts per hour and kind; windows still open at the watermark are not out yet."""
    events = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("verdict")
    )
    rows = _drain(jobs.verdict_windows(events), spark)
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "verdict", "n_checks"
    )


def _batched(stream, reduced, spark):
    """Run a stream over what is there now, two files a batch, and read what its batches reduced to."""
    base = f"{checkpoint_dir(spark)}/batches-{uuid.uuid4().hex}"
    jobs.write_batches(stream, reduced, f"{base}/out", f"{base}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def _late_events(spark, sf):
    """Events arriving in three rounds by number, so that later files hold rows of every hour again."""
    base = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    rows = v.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("verdict"),
        F.concat(F.lit("https://feed.example/"), F.col("user_id").cast("string")).alias("url"),
    )
    for n in range(3):
        rows.where(F.pmod("event_id", F.lit(3)) == n).write.mode("append").parquet(base)
    return jobs.read_files(spark, base, rows.schema, max_files=2)


@query(
    "streamed_first_rows",
    """SELECT 'https://feed.example/' || user_id AS url, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first_seen
       FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
)
def streamed_first_rows(spark, sf):
    """The first row of each feed URL by event time, whichever batch brings it."""
    reduced = lambda rows: jobs.first_rows(rows, ties=("event_id",))
    return reduced(_batched(_late_events(spark, sf).select("event_id", "ts", "url"), reduced, spark)).select(
        "url", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_seen")
    )


@query(
    "streamed_window_totals",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS verdict, count(*) AS n_checks
       FROM events GROUP BY ALL""",
)
def streamed_window_totals(spark, sf):
    """Counts per hour and kind over all rows, late ones and windows still open included."""
    reduced = lambda rows: jobs.window_counts(rows, time="ts")
    totals = jobs.window_totals(_batched(_late_events(spark, sf).select("ts", "verdict"), reduced, spark))
    return totals.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "verdict", "n_checks")
