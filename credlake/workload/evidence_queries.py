"""Search results, sources, evidence, fact checks, verdicts, scans, stored results."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from credlake.functions import answers, rules, urls
from credlake.operators import evidence as ev
from credlake.operators import results as rs
from credlake.operators import scan as sc
from credlake.operators import verdicts as vd
from credlake.operators.common import checkpoint_dir, materialize
from credlake.plans import verification as vp
from credlake.sources import committed, news_files
from credlake.sources.search_payloads import normalize_payloads
from credlake.workload import sql_views as q
from credlake.workload import views as v
from credlake.workload.registry import query

JOINED = "array_to_string({x}, ' | ')"


def _joined(col):
    return F.array_join(col, " | ")


# ---- queries and rules ------------------------------------------------------


@query(
    "search_queries",
    """SELECT claim_id, i - 1 AS query_no, q FROM (
         SELECT claim_id, unnest(qs) AS q, unnest(range(1, len(qs) + 1)) AS i FROM (
           SELECT claim_id, list_filter([text,
                  CASE WHEN len(ws) > 5 THEN array_to_string(ws[1:5], ' ') END,
                  CASE WHEN len(ws) > 5 THEN array_to_string(ws[len(ws)-4:len(ws)], ' ') END,
                  text || ' official', text || ' fact check', text || ' government'], lambda x: x IS NOT NULL) AS qs
           FROM v_claim_queries))""",
)
def search_queries(spark, sf):
    listed = F.posexplode(rules.search_queries(F.col("text"))).alias("query_no", "q")
    return v.claims(spark, sf).select("claim_id", listed)


@query(
    "fact_check_and_scan_queries",
    """SELECT claim_id, purpose, i AS query_no, q FROM (
         SELECT claim_id, 'pipeline' AS purpose, unnest([text || ' fact check', text || ' politifact']) AS q, unnest(range(2)) AS i FROM v_claims
         UNION ALL SELECT claim_id, 'service', unnest([text || ' fact check', text || ' politifact', text || ' snopes', text || ' factcheck.org']), unnest(range(4)) FROM v_claims
         UNION ALL SELECT claim_id, 'scan', unnest([text, text || ' fact check']), unnest(range(2)) FROM v_claims)""",
)
def fact_check_and_scan_queries(spark, sf):
    text = F.col("text")
    kinds = {
        "pipeline": rules.fact_check_queries(text),
        "service": rules.fact_check_service_queries(text),
        "scan": rules.scan_queries(text),
    }
    # one pass over the claims: all lists side by side, then unrolled
    entries = F.array(*[F.struct(F.lit(k).alias("purpose"), c.alias("qs")) for k, c in kinds.items()])
    rows = v.claims(spark, sf).select("claim_id", F.inline(entries))
    return rows.select("claim_id", "purpose", F.posexplode("qs").alias("query_no", "q"))


@query(
    "site_queries",
    """SELECT source_url, 'site:' || source_url || ' latest news' AS scan, 'site:' || source_url || ' latest news today' AS trending,
              'site:' || source_url || ' new update today' AS daily FROM v_registry""",
)
def site_queries(spark, sf):
    url = F.col("source_url")
    return v.registry(spark, sf).select(
        "source_url", *[rules.site_query(url, p).alias(p) for p in ("scan", "trending", "daily")]
    )


DOMAIN_FORMS = ["http://user:pw@", "HTTPS://", "//", ""]


@query(
    "url_domains",
    f"""SELECT page_id, link, {q.domain('link')} AS domain FROM (
          SELECT page_id, {q.pick('page_id % 4', DOMAIN_FORMS)} || upper(regexp_extract(url, '^https?://([^/]+)', 1))
                 || CASE WHEN page_id % 3 = 0 THEN ':8080' ELSE '' END || '/a b?c' AS link FROM pages)""",
)
def url_domains(spark, sf):
    page = F.col("page_id")
    link = F.concat(
        v.pick(page % 4, DOMAIN_FORMS),
        F.upper(F.regexp_extract("url", "^https?://([^/]+)", 1)),
        F.when(page % 3 == 0, ":8080").otherwise(""),
        F.lit("/a b?c"),
    )
    rows = v.table(spark, sf, "pages").select("page_id", link.alias("link"))
    return rows.withColumn("domain", urls.domain(F.col("link")))


HOST_FORMS = [
    "www.nasa.gov", "army.mil.example", "govt.nz", "mygovernment.org", "factcheck.org", "snopes.com", "ap.org",
    "mit.edu", "ox.ac.uk", "university.example", "bbc.com", "dailynews.com", "who.int", "gov.example.com",
    "u-tokyo.ac.jp", "npr.org", "apnews.com", "un.org", "blog.example.com", "institute.example",
]


@query(
    "source_types",
    f"""SELECT page_id, host, kind AS source_type, {q.analyzer_source_type('lower(host)')} AS analyzer_type,
               {q.credibility('kind')} AS credibility_score
        FROM (SELECT page_id, host, {q.source_type('lower(host)')} AS kind FROM (
              SELECT page_id, coalesce({q.pick('page_id % 25', HOST_FORMS)}, regexp_extract(url, '^https?://([^/]+)', 1)) AS host FROM pages))""",
)
def source_types(spark, sf):
    host = F.coalesce(v.pick(F.col("page_id") % 25, HOST_FORMS), F.regexp_extract("url", "^https?://([^/]+)", 1))
    rows = v.table(spark, sf, "pages").select("page_id", host.alias("host"))
    return rows.select(
        "page_id",
        "host",
        urls.source_type(F.lower("host")).alias("source_type"),
        urls.analyzer_source_type(F.col("host")).alias("analyzer_type"),
        urls.credibility(urls.source_type(F.lower("host"))).alias("credibility_score"),
    )


# ---- evidence ---------------------------------------------------------------


@query("merged_search_results", "SELECT claim_id, query_no, rank, url, position FROM v_merged")
def merged_search_results(spark, sf):
    merged = ev.merge_search_results(v.search_results(spark, sf), v.claims(spark, sf))
    return merged.select("claim_id", "query_no", "rank", "url", "position")


@query("claim_candidates", "SELECT claim_id, request_id, rank, title FROM v_candidates")
def claim_candidates(spark, sf):
    return v.candidates(spark, sf).select("claim_id", "request_id", "rank", "title")


SOURCE = ["source_id", "request_id", "url", "title", "domain", "source_type", "publisher", "publication_date", "credibility_score", "is_independent"]


@query("source_rows", "SELECT source_id, request_id, rank, domain, source_type, " + q.credibility("source_type") + " AS credibility_score FROM v_all_sources")
def source_rows(spark, sf):
    return ev.source_rows(v.candidates(spark, sf)).select(
        "source_id", "request_id", "rank", "domain", "source_type", "credibility_score"
    )


@query("unique_sources", f"SELECT {', '.join(SOURCE)} FROM v_sources")
def unique_sources(spark, sf):
    return v.sources(spark, sf).select(*SOURCE)


@query("evidence_rows", "SELECT evidence_id, request_id, claim_id, source_id, title, text, relation, confidence FROM v_evidence")
def evidence_rows(spark, sf):
    return v.evidence_items(spark, sf).select(
        "evidence_id", "request_id", "claim_id", "source_id", "title", "text", "relation", "confidence"
    )


TITLE_WORDS = ["Minister denies ", "It is not true that ", "Really ", "incorrect: ", "A Plain ", "TRUE ", "Official "]


@query(
    "title_relations",
    f"""SELECT page_id, title, {q.relation('lower(title)')} AS relation, {q.scan_relation('lower(title)')} AS scan_relation
        FROM (SELECT page_id, {q.pick('page_id % 7', TITLE_WORDS)} || regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)""",
)
def title_relations(spark, sf):
    title = F.concat(v.pick(F.col("page_id") % 7, TITLE_WORDS), v.page_title_text())
    rows = v.table(spark, sf, "pages").select("page_id", title.alias("title"))
    return rows.select(
        "page_id",
        "title",
        rules.relation(F.lower("title")).alias("relation"),
        rules.scan_relation(F.lower("title")).alias("scan_relation"),
    )


@query(
    "pipeline_fact_checks",
    """SELECT claim_id, position, string_split_regex(trim(title), '\\s+')[1] AS organization, substr(claim_text, 1, 200) AS claim_checked,
              'See source for details' AS conclusion, substr(snippet, 1, 300) AS summary, published_date AS date, url
       FROM (SELECT c.text AS claim_text, r.*, row_number() OVER (PARTITION BY r.claim_id ORDER BY query_no, rank) AS position
             FROM v_claims c JOIN v_search_results r ON c.claim_id = r.claim_id
             WHERE """
    + q.has("lower(title)", rules.PIPELINE_FACT_CHECK_TITLES)
    + ") WHERE position <= 3",
)
def pipeline_fact_checks(spark, sf):
    rows = ev.pipeline_fact_checks(v.claims(spark, sf), v.search_results(spark, sf))
    return rows.drop("request_id")


def _service_sql() -> str:
    hit = f"({q.has('lower(url)', rules.FACT_CHECK_URLS)} OR {q.has('lower(title)', rules.FACT_CHECK_TITLES)})"
    hedged = q.has("body", rules.HEDGES)
    conclusion = q.cases(
        [
            (q.has("body", rules.TRUE_WORDS), f"CASE WHEN {hedged} THEN 'Mostly True' ELSE 'True' END"),
            (q.has("body", rules.FALSE_WORDS), f"CASE WHEN {hedged} THEN 'Mostly False' ELSE 'False' END"),
            (q.has("body", rules.MISLEADING_WORDS), "'Misleading'"),
            (q.has("body", rules.UNPROVEN_WORDS), "'Unverified'"),
        ],
        "'See source for details'",
    )
    org = q.cases(
        [(q.has("lower(url)", w), q.text(n)) for w, n in rules.ORGANISATIONS],
        "'Unknown Fact-Checking Organization'",
    )
    return f"""
        SELECT claim_id, position, {org} AS organization, substr(claim_text, 1, 300) AS claim_checked,
               {conclusion} AS conclusion, substr(snippet, 1, 500) AS summary, published_date AS date, url, title
        FROM (SELECT *, lower(title || ' ' || snippet) AS body,
                     row_number() OVER (PARTITION BY claim_id ORDER BY query_no, rank) AS position
              FROM (SELECT c.text AS claim_text, r.*, row_number() OVER (PARTITION BY r.claim_id, url ORDER BY query_no, rank) AS copy_no
                    FROM v_claims c JOIN v_search_results r ON c.claim_id = r.claim_id WHERE url <> '' AND {hit})
              WHERE copy_no = 1) WHERE position <= 5"""


@query("service_fact_checks", _service_sql())
def service_fact_checks(spark, sf):
    rows = ev.service_fact_checks(v.claims(spark, sf), v.search_results(spark, sf))
    return rows.drop("request_id")


CHECK_URLS = ["politifact.com/x", "www.snopes.com", "factcheck.org/a", "reuters.com/fact-check/b", "apnews.com", "bbc.com/reality_check", "npr.org/sections/factcheck/c", "other.example"]
CHECK_TEXTS = ["Mostly accurate report", "Claim is incorrect", "Partially wrong", "debunked", "lacks context", "No evidence found", "plain", "MYTH busted"]


@query(
    "fact_check_rules",
    f"""SELECT doc_id, link, body_text, {q.has('lower(link)', rules.FACT_CHECK_URLS)} OR {q.has('lower(body_text)', rules.FACT_CHECK_TITLES)} AS is_fact_check,
               {q.cases([(q.has('lower(link)', w), q.text(n)) for w, n in rules.ORGANISATIONS], "'Unknown Fact-Checking Organization'")} AS organization,
               {q.cases([(q.has('lower(body_text)', rules.TRUE_WORDS), "CASE WHEN " + q.has('lower(body_text)', rules.HEDGES) + " THEN 'Mostly True' ELSE 'True' END"),
                         (q.has('lower(body_text)', rules.FALSE_WORDS), "CASE WHEN " + q.has('lower(body_text)', rules.HEDGES) + " THEN 'Mostly False' ELSE 'False' END"),
                         (q.has('lower(body_text)', rules.MISLEADING_WORDS), "'Misleading'"), (q.has('lower(body_text)', rules.UNPROVEN_WORDS), "'Unverified'")], "'See source for details'")} AS conclusion
        FROM (SELECT doc_id, 'https://' || {q.pick('doc_id % 8', CHECK_URLS)} AS link, {q.pick('(doc_id // 8) % 8', CHECK_TEXTS)} || ' ' || title AS body_text FROM v_news)""",
)
def fact_check_rules(spark, sf):
    d = F.col("doc_id")
    rows = v.news(spark, sf).select(
        "doc_id",
        F.concat(F.lit("https://"), v.pick(d % 8, CHECK_URLS)).alias("link"),
        F.concat(v.pick(F.floor(d / 8) % 8, CHECK_TEXTS), F.lit(" "), "title").alias("body_text"),
    )
    link, body = F.lower("link"), F.lower("body_text")
    return rows.select(
        "doc_id",
        "link",
        "body_text",
        rules.is_fact_check_source(link, body).alias("is_fact_check"),
        rules.organisation(link).alias("organization"),
        rules.conclusion(body).alias("conclusion"),
    )


@query(
    "evidence_with_source",
    """SELECT e.evidence_id, e.relation, s.source_id IS NOT NULL AS has_source, s.domain, s.source_type, s.credibility_score
       FROM v_evidence e LEFT JOIN (SELECT * FROM v_sources WHERE domain <> 'agency.gov') s ON e.source_id = s.source_id""",
)
def evidence_with_source(spark, sf):
    """Some sources are left out, so that evidence without a source occurs."""
    sources, evidence = v.sources_and_evidence(spark, sf)
    joined = ev.evidence_with_source(evidence, sources.filter(F.col("domain") != "agency.gov"))
    return joined.select(
        "evidence_id",
        "relation",
        F.col("source").isNotNull().alias("has_source"),
        "source.domain",
        "source.source_type",
        "source.credibility_score",
    )


@query("cited_sources", "SELECT source_id, url FROM v_sources WHERE source_id IN (SELECT source_id FROM v_evidence)")
def cited_sources(spark, sf):
    return ev.cited_sources(*v.sources_and_evidence(spark, sf)).select("source_id", "url")


@query("evidence_scores", "SELECT evidence_id, score FROM v_evidence_scores")
def evidence_scores(spark, sf):
    sources, evidence = v.sources_and_evidence(spark, sf)
    return ev.scored_evidence(evidence, sources).select("evidence_id", "score")


@query(
    "evidence_group_scores",
    """SELECT r.request_id, CAST(round(greatest(0.0, least(100.0, coalesce(sum(e.score * e.confidence), 0))), 6) AS DOUBLE) AS group_score
       FROM v_request_ids r LEFT JOIN v_evidence_scores e ON r.request_id = e.request_id GROUP BY r.request_id""",
)
def evidence_group_scores(spark, sf):
    sources, evidence = v.sources_and_evidence(spark, sf)
    scored = ev.scored_evidence(evidence, sources)
    return ev.group_scores(v.requests(spark, sf).select("request_id"), scored)


@query(
    "evidence_counts",
    """SELECT request_id, count(*) FILTER (relation = 'supports') AS supporting, count(*) FILTER (relation = 'contradicts') AS contradicting,
              count(*) FILTER (relation = 'neutral') AS neutral FROM v_evidence GROUP BY 1""",
)
def evidence_counts(spark, sf):
    return ev.evidence_counts(v.evidence_items(spark, sf))


@query(
    "source_counts",
    "SELECT request_id, count(*) AS n_sources, count(*) FILTER (source_type = 'primary') AS n_primary FROM v_sources GROUP BY 1",
)
def source_counts(spark, sf):
    return ev.source_counts(v.sources(spark, sf))


@query(
    "source_independence",
    """SELECT request_id, CAST(sum(n) AS BIGINT) AS total_sources, count(*) FILTER (n = 1) AS independent_sources,
              count(*) FILTER (n > 1) AS dependent_groups, round(count(*) FILTER (n = 1) / sum(n)::DOUBLE, 6) AS true_independence_ratio
       FROM (SELECT request_id, domain, count(*) AS n FROM v_sources GROUP BY ALL) GROUP BY 1""",
)
def source_independence(spark, sf):
    return ev.source_independence(v.sources(spark, sf))


@query(
    "dependent_source_groups",
    """SELECT request_id, domain, CAST(page AS INTEGER) AS page, n_sources, string_agg(url, ' | ' ORDER BY url) AS urls
       FROM (SELECT request_id, domain, url, (row_number() OVER (PARTITION BY request_id, domain ORDER BY url) - 1) // 2 AS page,
                    count(*) OVER (PARTITION BY request_id, domain) AS n_sources FROM v_sources)
       WHERE n_sources > 1 GROUP BY request_id, domain, page, n_sources""",
)
def dependent_source_groups(spark, sf):
    return ev.dependent_source_groups(v.sources(spark, sf), page_urls=2).withColumn("urls", _joined("urls"))


@query(
    "source_relation_counts",
    """SELECT source_id, count(*) FILTER (relation = 'supports') AS supporting_evidence_count,
              count(*) FILTER (relation = 'contradicts') AS contradicting_evidence_count FROM v_evidence GROUP BY 1""",
)
def source_relation_counts(spark, sf):
    return ev.source_relation_counts(v.evidence_items(spark, sf))


@query(
    "source_analysis",
    """SELECT s.source_id, coalesce(e.sup, 0) AS supporting_evidence_count, coalesce(e.con, 0) AS contradicting_evidence_count,
              CASE source_type WHEN 'primary' THEN 'High trust weight' WHEN 'fact_check' THEN 'Specialized verification'
                   WHEN 'secondary' THEN 'Established news organization' ELSE '' END AS factors,
              concat_ws(' | ', CASE source_type WHEN 'primary' THEN 'Primary source - direct from original publisher'
                                    WHEN 'fact_check' THEN 'Reputable fact-checking organization' END,
                        CASE WHEN is_independent THEN 'Independent source' END,
                        CASE WHEN credibility_score >= 0.8 THEN 'High credibility score' END) AS strengths,
              concat_ws(' | ', CASE WHEN credibility_score <= 0.4 THEN 'Low credibility score' END,
                        CASE WHEN e.sup > 0 AND e.con > 0 THEN 'Source provides both supporting and contradicting evidence' END) AS warnings
       FROM v_sources s LEFT JOIN (SELECT source_id, count(*) FILTER (relation = 'supports') AS sup,
            count(*) FILTER (relation = 'contradicts') AS con FROM v_evidence GROUP BY 1) e ON s.source_id = e.source_id""",
)
def source_analysis(spark, sf):
    rows = ev.analyze_sources(*v.sources_and_evidence(spark, sf))
    return rows.select(
        "source_id",
        "supporting_evidence_count",
        "contradicting_evidence_count",
        *[_joined(n).alias(n) for n in ("factors", "strengths", "warnings")],
    )


@query(
    "evidence_texts",
    """SELECT request_id, relation, position, evidence_id, text FROM (
         SELECT *, row_number() OVER (PARTITION BY request_id, relation ORDER BY claim_id, evidence_id) AS position FROM v_evidence)
       WHERE position <= 5""",
)
def evidence_texts(spark, sf):
    return ev.evidence_texts(v.evidence_items(spark, sf)).select(
        "request_id", "relation", "position", "evidence_id", "text"
    )


# ---- verdicts ---------------------------------------------------------------


def _run(spark, sf):
    return vp.verify(
        v.requests(spark, sf), v.claims(spark, sf), v.search_results(spark, sf), v.headlines(spark, sf)
    )


@query(
    "verdict_rows",
    """SELECT request_id, score, verdict, evidence_strength, round(confidence, 6) AS confidence, limitations,
              s AS supporting_evidence_count, c AS contradicting_evidence_count, n AS neutral_evidence_count FROM v_verdicts""",
)
def verdict_rows(spark, sf):
    return _run(spark, sf).verdicts.select(
        "request_id", "score", "verdict", "evidence_strength", F.round("confidence", 6).alias("confidence"),
        "limitations", "supporting_evidence_count", "contradicting_evidence_count", "neutral_evidence_count",
    )


@query(
    "verdict_explanations",
    """SELECT request_id, 'Analyzed ' || t || ' sources including ' || p || ' primary sources. Found ' || s || ' supporting, ' || c
              || ' contradicting, and ' || n || ' neutral evidence items.' AS evidence_summary,
              concat_ws(' | ', CASE WHEN p > 0 THEN p || ' primary source(s) analyzed' END, CASE WHEN c > 0 THEN c || ' contradicting evidence item(s)' END,
                        CASE WHEN s > 0 THEN s || ' supporting evidence item(s)' END, CASE WHEN ex THEN 'headline exaggeration detected' END) AS factors,
              CASE WHEN limitations = '' THEN 0 ELSE len(string_split(limitations, '; ')) END AS n_limitations
       FROM v_verdicts""",
)
def verdict_explanations(spark, sf):
    return _run(spark, sf).verdicts.select(
        "request_id",
        "evidence_summary",
        _joined("factors").alias("factors"),
        F.size(vd.limitation_list(F.col("limitations"))).alias("n_limitations"),
    )


@query(
    "verdict_rule_grid",
    f"""SELECT event_id, CASE WHEN s = 0 AND c = 0 THEN 'unverified' ELSE {q.bucketed('score', 1)} END AS verdict,
               CASE WHEN s = 0 AND c = 0 THEN 'UNKNOWN' ELSE {q.bucketed('score', 2)} END AS evidence_strength, score,
               round(CAST(CASE WHEN s = 0 AND c = 0 THEN 0.3 ELSE least(0.99, 0.5 + (s + c) * 0.05) END AS DOUBLE), 6) AS confidence
        FROM (SELECT *, greatest(0, least(100, 50 + 5 * s + 10 * p - 8 * c - 2 * n)) AS score
              FROM (SELECT event_id, event_id % 9 AS s, event_id % 7 AS c, event_id % 5 AS n, event_id % 4 AS p FROM events))""",
)
def verdict_rule_grid(spark, sf):
    """The scoring rules over many combinations of counts, so every bucket occurs."""
    e = F.col("event_id")
    no = F.lit(False)
    s, c, n, p = e % 9, e % 7, e % 5, e % 4
    score = rules.verdict_score(s, c, n, p, no, no)
    return v.table(spark, sf, "events").select(
        "event_id",
        rules.verdict(score, s, c).alias("verdict"),
        rules.evidence_strength(score, s, c).alias("evidence_strength"),
        score.alias("score"),
        F.round(rules.verdict_confidence(s, c), 6).alias("confidence"),
    )


@query(
    "engine_assessment",
    """SELECT event_id, round(CAST(CASE WHEN t = 0 OR s + c + n = 0 THEN 0.3 ELSE least(0.99, greatest(0.1,
                0.5 - CASE WHEN s > 0 AND c > 0 THEN least(0.15, abs(s - c) * 0.01) ELSE 0 END
                + least(0.3, (s + c + n) * 0.03) + least(0.2, t * 0.02))) END AS DOUBLE), 6) AS engine_confidence,
              CASE WHEN p >= 2 AND s >= 3 AND c = 0 THEN 'HIGH' WHEN p >= 1 AND s >= 2 THEN 'MEDIUM-HIGH' WHEN s >= 2 THEN 'MEDIUM'
                   WHEN s >= 1 THEN 'LOW' ELSE 'VERY LOW' END AS engine_strength
       FROM (SELECT event_id, event_id % 9 AS s, event_id % 7 AS c, event_id % 5 AS n, event_id % 11 AS t, event_id % 4 AS p FROM events)""",
)
def engine_assessment(spark, sf):
    e = F.col("event_id")
    counts = v.table(spark, sf, "events").select(
        "event_id", (e % 9).alias("supporting"), (e % 7).alias("contradicting"), (e % 5).alias("neutral"),
        (e % 11).alias("n_sources"), (e % 4).alias("n_primary"),
    )
    return vd.engine_assessment(counts).select(
        "event_id", F.round("engine_confidence", 6).alias("engine_confidence"), "engine_strength"
    )


@query(
    "request_status",
    """SELECT request_id, CASE WHEN status = 'failed' THEN 'failed' WHEN request_id IN (SELECT request_id FROM v_verdicts) THEN 'completed'
              ELSE 'processing' END AS status FROM v_requests""",
)
def request_status(spark, sf):
    return vd.request_status(v.requests(spark, sf), _run(spark, sf).verdicts).select("request_id", "status")


@query(
    "failure_rows",
    """SELECT page_id, CASE WHEN err <> '' OR txt = '' THEN 'failed' ELSE 'completed' END AS status,
              CASE WHEN err <> '' THEN coalesce(msg, 'Extraction failed') WHEN txt = '' THEN 'No content extracted' END AS failure,
              CASE WHEN err <> '' OR txt = '' THEN 'unverified' ELSE 'verified' END AS verdict,
              CAST(CASE WHEN err <> '' OR txt = '' THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence,
              CASE WHEN err <> '' OR txt = '' THEN 'unknown' ELSE 'HIGH' END AS evidence_strength
       FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_error' ELSE '' END AS err,
                    CASE page_id % 6 WHEN 0 THEN 'The page took too long to load.' END AS msg,
                    CASE page_id % 6 WHEN 2 THEN '' ELSE html END AS txt FROM pages)""",
)
def failure_rows(spark, sf):
    kind = F.col("page_id") % 6
    rows = v.table(spark, sf, "pages").select(
        "page_id",
        F.when(kind == 0, "timeout").when(kind == 1, "http_error").alias("error"),
        F.when(kind == 0, "The page took too long to load.").alias("message"),
        F.when(kind == 2, "").otherwise(F.col("html")).alias("text"),
        F.lit("verified").alias("verdict"),
        F.lit(0.9).alias("confidence"),
        F.lit("HIGH").alias("evidence_strength"),
    )
    return vd.with_failures(rows).select(
        "page_id", "status", "failure", "verdict", "confidence", "evidence_strength"
    )


@query(
    "timeline_events",
    """SELECT request_id, year, label, type FROM (
         SELECT request_id, CAST(CASE WHEN request_id % 3 = 0 THEN 2024 ELSE 2015 + request_id % 9 END AS INTEGER) AS year,
                'Original Event / Source Publication' AS label, 'source' AS type FROM v_requests
         UNION ALL SELECT request_id, CAST(year(created_at) AS INTEGER), 'Current Verification', 'verification' FROM v_requests
         UNION ALL SELECT request_id, CAST(year(created_at) AS INTEGER), 'Headline Exaggeration Detected', 'warning' FROM v_requests
                   WHERE request_id % 5 = 0)""",
)
def timeline_events(spark, sf):
    r = F.col("request_id")
    date = F.concat((F.lit(2015) + r % 9).cast("string"), F.lit("-03-01"))
    docs = v.requests(spark, sf).select(
        "request_id",
        F.when(r % 3 == 1, date).when(r % 3 == 2, F.concat(date, F.lit("T10:00:00"))).otherwise("n/a").alias("event_date"),
        F.year("created_at").alias("verified_year"),
        (r % 5 == 0).alias("exaggeration_detected"),
    )
    return vd.timeline(docs)


# ---- stored model answers ---------------------------------------------------

ANSWER_SQL = """SELECT item_id, text, CASE item_id % 5
      WHEN 0 THEN to_json([{'text': text, 'subject': 'agency', 'certainty_level': 'high'}, {'text': upper(text), 'subject': NULL, 'certainty_level': 'low'}])::VARCHAR
      WHEN 1 THEN to_json({'claims': [{'text': text, 'subject': 'city', 'certainty_level': 'low'}]})::VARCHAR
      WHEN 2 THEN text WHEN 3 THEN '{"other": 1}' ELSE '[]' END AS answer FROM benchmark"""


@query(
    "claims_from_answers",
    """SELECT item_id AS request_id, position, text, subject, certainty_level FROM (
         SELECT item_id, 0 AS position, text, CASE item_id % 5 WHEN 0 THEN 'agency' WHEN 1 THEN 'city' ELSE '' END AS subject,
                CASE item_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS certainty_level FROM benchmark
         UNION ALL SELECT item_id, 1, upper(text), NULL, 'low' FROM benchmark WHERE item_id % 5 = 0)""",
)
def claims_from_answers(spark, sf):
    """Five answer shapes: array, object, plain text, object without claims, empty array."""
    item, text = F.col("item_id"), F.col("text")

    def claim(t, subject, level):
        return F.struct(t.alias("text"), F.lit(subject).cast("string").alias("subject"), F.lit(level).alias("certainty_level"))

    as_array = F.to_json(F.array(claim(text, "agency", "high"), claim(F.upper(text), None, "low")))
    as_object = F.to_json(F.struct(F.array(claim(text, "city", "low")).alias("claims")))
    answer = (
        F.when(item % 5 == 0, as_array)
        .when(item % 5 == 1, as_object)
        .when(item % 5 == 2, text)
        .when(item % 5 == 3, '{"other": 1}')
        .otherwise("[]")
    )
    rows = v.table(spark, sf, "benchmark").select(
        item.alias("request_id"), "text", answer.alias("answer"), F.lit("Other").alias("category_answer")
    )
    return vp.claims_from_answers(rows).select("request_id", "position", "text", "subject", "certainty_level")


CATEGORY_ANSWERS = ["The category is HEALTH.", "Sports and politics", "local news", "none", "International affairs"]


@query(
    "answer_categories",
    "SELECT conv_id, turn, "
    + q.cases([(f"contains(lower(answer), {q.text(c.lower())})", q.text(c)) for c in rules.CATEGORIES], "'Other'")
    + f" AS category FROM (SELECT conv_id, turn, coalesce({q.pick('(conv_id + turn) % 7', CATEGORY_ANSWERS)}, text) AS answer FROM conversations)",
)
def answer_categories(spark, sf):
    answer = F.coalesce(v.pick((F.col("conv_id") + F.col("turn")) % 7, CATEGORY_ANSWERS), F.col("text"))
    return v.table(spark, sf, "conversations").select("conv_id", "turn", rules.category(answer).alias("category"))


HEADLINE_ANSWERS = [
    '{"clickbait_score": 0.7, "exaggeration_detected": true, "headline_body_contradiction": false, "notes": ["loud", "caps"]}',
    '{"clickbait_score": 0.2, "exaggeration_detected": false, "headline_body_contradiction": true, "notes": []}',
    "not json at all",
]


@query(
    "headline_answers",
    """SELECT request_id, CAST(CASE WHEN request_id % 4 <> 0 THEN 0.0 ELSE CASE request_id % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 0.2 ELSE 0.0 END END AS DOUBLE) AS clickbait_score,
              request_id % 4 = 0 AND request_id % 3 = 0 AS exaggeration_detected, request_id % 4 = 0 AND request_id % 3 = 1 AS headline_body_contradiction,
              CASE WHEN request_id % 4 <> 0 THEN '' ELSE CASE request_id % 3 WHEN 0 THEN 'loud | caps' WHEN 1 THEN '' ELSE 'Analysis could not be completed.' END END AS notes
       FROM v_requests""",
)
def headline_answers(spark, sf):
    answer = v.pick(F.col("request_id") % 3, HEADLINE_ANSWERS)
    rows = v.requests(spark, sf).withColumn(
        "h", answers.headline_analysis(answer, F.col("input_type"), F.lit("title"), F.col("original_text"))
    )
    return rows.select(
        "request_id", "h.clickbait_score", "h.exaggeration_detected", "h.headline_body_contradiction",
        _joined("h.notes").alias("notes"),
    )


@query(
    "typed_answers",
    """SELECT conv_id, turn, ok AS is_factual, false AS is_opinion, CASE WHEN ok THEN 'because' ELSE 'Default assumption' END AS opinion_reasoning,
              CASE WHEN ok THEN 'supports' ELSE 'neutral' END AS assessment, CAST(CASE WHEN ok THEN 0.9 ELSE 0.5 END AS DOUBLE) AS comparison_confidence,
              ok AS is_outdated, CASE WHEN ok THEN 'old' ELSE 'Date analysis could not be completed.' END AS temporal_notes,
              CASE WHEN ok THEN 'now' ELSE text END AS current_context
       FROM (SELECT conv_id, turn, text, (conv_id + turn) % 2 = 0 AS ok FROM conversations) WHERE ok OR NOT ok""".replace("ok AS is_factual", "true AS is_factual"),
)
def typed_answers(spark, sf):
    """Stored analyses, every second one malformed."""
    good = (F.col("conv_id") + F.col("turn")) % 2 == 0

    def answer(text: str):
        return F.when(good, text).otherwise(F.col("text"))

    rows = v.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        answers.parse_answer(answer('{"is_factual": true, "is_opinion": false, "reasoning": "because"}'), "opinion").alias("o"),
        answers.parse_answer(answer('{"assessment": "supports", "confidence": 0.9}'), "comparison").alias("c"),
        answers.parse_answer(answer('{"is_outdated": true, "notes": "old"}'), "temporal").alias("t"),
        answers.parse_answer(
            answer('{"is_reused": true, "current_context": "now"}'), "media_reuse", {"current_context": F.col("text")}
        ).alias("m"),
    )
    return rows.select(
        "conv_id", "turn", "o.is_factual", "o.is_opinion", F.col("o.reasoning").alias("opinion_reasoning"),
        "c.assessment", F.col("c.confidence").alias("comparison_confidence"), "t.is_outdated",
        F.col("t.notes").alias("temporal_notes"), "m.current_context",
    )


PROVIDERS = ["tavily", "brave", "serpapi", "tavily"]


@query(
    "search_payloads",
    """SELECT page_id, rank, url, title, snippet, score, published_date FROM (
         SELECT page_id, 1 AS rank, url, t AS title, 'first' AS snippet, CAST(CASE page_id % 4 WHEN 2 THEN 1.0 ELSE 0.25 END AS DOUBLE) AS score, '2024-01-01' AS published_date
         FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages) WHERE page_id % 4 <> 3
         UNION ALL SELECT page_id, 2, '', '', 'second', CAST(CASE page_id % 4 WHEN 2 THEN 1.0 ELSE 0.0 END AS DOUBLE), NULL FROM pages WHERE page_id % 4 <> 3)""",
)
def search_payloads(spark, sf):
    """Payloads of three providers, and malformed ones."""
    page = F.col("page_id")

    def items(url: str, snippet: str, date: str, score: bool):
        first = [F.col("url").alias(url), F.col("t").alias("title"), F.lit("first").alias(snippet), F.lit("2024-01-01").alias(date)]
        second = [F.lit(None).cast("string").alias(url), F.lit(None).cast("string").alias("title"), F.lit("second").alias(snippet), F.lit(None).cast("string").alias(date)]
        if score:
            first.append(F.lit(0.25).alias("score"))
            second.append(F.lit(None).cast("double").alias("score"))
        return F.array(F.struct(*first), F.struct(*second))

    payload = (
        F.when(page % 4 == 0, F.to_json(F.struct(items("url", "content", "published_date", True).alias("results"))))
        .when(page % 4 == 1, F.to_json(F.struct(F.struct(items("url", "description", "page_age", True).alias("results")).alias("web"))))
        .when(page % 4 == 2, F.to_json(F.struct(items("link", "snippet", "date", False).alias("organic_results"))))
        .otherwise("{broken")
    )
    rows = v.table(spark, sf, "pages").withColumn("t", v.page_title_text())
    rows = rows.select("page_id", v.pick(page % 4, PROVIDERS).alias("provider"), payload.alias("payload"))
    return normalize_payloads(rows).drop("provider", "source")


# ---- scans ------------------------------------------------------------------


@query(
    "registry_articles",
    """SELECT r.rank, g.name AS source_name, g.source_url, g.country AS source_country, g.category, g.language, g.credibility
       FROM v_page_results r JOIN v_registry g ON r.source_url = g.source_url""",
)
def registry_articles(spark, sf):
    rows = sc.registry_articles(v.registry(spark, sf), v.site_results(spark, sf))
    return rows.select("rank", "source_name", "source_url", "source_country", "category", "language", "credibility")


def _report_sql(order: str, where: str, n_sources: int, per_source: int) -> str:
    return f"""
        SELECT source_no, position, url, title, source_url, credibility FROM (
          SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_no, position) AS copy_no FROM (
            SELECT t.source_no, r.*, t.credibility, row_number() OVER (PARTITION BY r.source_url ORDER BY rank) AS position
            FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS source_no FROM v_registry {where}) t
            JOIN v_page_results r ON r.source_url = t.source_url WHERE t.source_no <= {n_sources})
          WHERE position <= {per_source} AND url <> '')
        WHERE copy_no = 1 ORDER BY source_no, position LIMIT 20"""


@query("trending_report", _report_sql("seq, source_url", "WHERE list_kind = 'news'", 15, 2))
def trending_report(spark, sf):
    rows = sc.trending(v.registry(spark, sf), v.site_results(spark, sf))
    return rows.select("source_no", "position", "url", "title", "source_url", "credibility")


@query(
    "daily_report",
    _report_sql("CASE WHEN list_kind = 'news' THEN 0 ELSE 1 END, seq, source_url", "", 20, 1),
)
def daily_report(spark, sf):
    rows = sc.daily_updates(v.registry(spark, sf), v.site_results(spark, sf))
    return rows.select("source_no", "position", "url", "title", "source_url", "credibility")


@query(
    "category_scan",
    """SELECT list_kind, source_url, count(*) AS n_articles, string_agg(url, ' | ' ORDER BY position) AS urls FROM (
         SELECT t.list_kind, r.source_url, r.url, row_number() OVER (PARTITION BY r.source_url ORDER BY rank) AS position
         FROM (SELECT *, row_number() OVER (PARTITION BY list_kind ORDER BY seq, source_url) AS source_no FROM v_registry) t
         JOIN v_page_results r ON r.source_url = t.source_url WHERE t.source_no <= 10)
       WHERE position <= 3 GROUP BY ALL""",
)
def category_scan(spark, sf):
    rows = sc.category_scan(v.registry(spark, sf), v.site_results(spark, sf))
    return rows.select(
        "list_kind", "source_url", F.size("articles").alias("n_articles"), _joined("articles.url").alias("urls")
    )


@query("scan_counts", "SELECT * FROM v_scan_counts")
def scan_counts(spark, sf):
    return sc.scan_counts(v.article_results(spark, sf))


@query(
    "scan_verdicts",
    f"""SELECT article_id, evidence_count, supporting, contradicting, claims_checked, score,
               CASE WHEN is_empty OR evidence_count = 0 THEN 'unverified' ELSE {q.bucketed('score', 1)} END AS verdict,
               round(CAST(CASE WHEN is_empty THEN 0.0 ELSE least(0.95, 0.3 + evidence_count * 0.05) END AS DOUBLE), 6) AS confidence,
               CASE WHEN is_empty THEN 'No content to verify' END AS reason
        FROM (SELECT *, greatest(0, least(100, 50 + 5 * supporting - 8 * contradicting)) AS score FROM (
              SELECT a.article_id, a.title = '' AND a.snippet = '' AS is_empty, coalesce(c.evidence_count, 0) AS evidence_count,
                     coalesce(c.supporting, 0) AS supporting, coalesce(c.contradicting, 0) AS contradicting, coalesce(c.claims_checked, 0) AS claims_checked
              FROM v_scan_articles a LEFT JOIN v_scan_counts c ON a.article_id = c.article_id))""",
)
def scan_verdicts(spark, sf):
    rows = sc.scan_verdicts(v.scan_articles(spark, sf), sc.scan_counts(v.article_results(spark, sf)))
    return rows.select(
        "article_id", "evidence_count", "supporting", "contradicting", "claims_checked", "score", "verdict",
        F.round("confidence", 6).alias("confidence"), "reason",
    )


@query(
    "batch_totals",
    "SELECT count(*) AS n_articles, count(*) FILTER (title <> '' OR snippet <> '') AS n_valid FROM v_scan_articles",
)
def batch_totals(spark, sf):
    valid = (F.col("title") != "") | (F.col("snippet") != "")
    return rs.batch_totals(v.scan_articles(spark, sf), valid, ("n_articles", "n_valid"))


# ---- stored results ---------------------------------------------------------


def _stored(spark, sf):
    """The child tables of one run as they are stored, with plain ids."""
    run = _run(spark, sf)
    evidence = ["evidence_id", "request_id", "claim_id", "source_id", "text", "relation", "confidence"]
    tables = {
        "claims": v.claims(spark, sf).select("claim_id", "request_id", "text", "category", "certainty_level"),
        "verdicts": run.verdicts,
        "evidence": run.evidence.select(*evidence),
        "sources": run.sources.select(*SOURCE),
        "fact_checks": run.fact_checks.select("fact_check_id", "request_id", "organization", "url"),
    }
    stored = {name: materialize(df, name) for name, df in tables.items()}
    return {**stored, "media": v.media(spark, sf)}


@query(
    "result_documents",
    """SELECT * FROM (WITH items AS (
           SELECT request_id, 'claim' AS kind, claim_id::VARCHAR AS id, row_number() OVER (PARTITION BY request_id ORDER BY claim_id) AS n, '' AS tag FROM v_claims
           UNION ALL SELECT request_id, 'evidence', evidence_id, row_number() OVER (PARTITION BY request_id ORDER BY evidence_id), relation FROM v_evidence
           UNION ALL SELECT request_id, 'source', source_id, row_number() OVER (PARTITION BY request_id ORDER BY source_id), source_type FROM v_sources
           UNION ALL SELECT request_id, 'media', media_id::VARCHAR, row_number() OVER (PARTITION BY request_id ORDER BY media_id), media_type FROM v_media
           UNION ALL SELECT request_id, 'none', '', 1, '' FROM v_requests),
         pages AS (
           SELECT request_id, CAST((n - 1) // 2 AS INTEGER) AS page,
                  coalesce(string_agg(id, ' | ' ORDER BY n) FILTER (kind = 'claim'), '') AS claim_ids,
                  coalesce(string_agg(id, ' | ' ORDER BY n) FILTER (kind = 'evidence' AND tag = 'supports'), '') AS supporting_ids,
                  coalesce(string_agg(id, ' | ' ORDER BY n) FILTER (kind = 'evidence' AND tag = 'contradicts'), '') AS contradicting_ids,
                  coalesce(string_agg(id, ' | ' ORDER BY n) FILTER (kind = 'evidence' AND tag = 'neutral'), '') AS neutral_ids,
                  coalesce(string_agg(id, ' | ' ORDER BY n) FILTER (kind = 'source'), '') AS source_ids,
                  coalesce(string_agg(id, ' | ' ORDER BY n) FILTER (kind = 'source' AND tag = 'primary'), '') AS primary_ids,
                  count(*) FILTER (kind = 'media' AND tag = 'image') AS images, count(*) FILTER (kind = 'media' AND tag = 'video') AS videos
           FROM items GROUP BY 1, 2),
         media AS (SELECT request_id, count(*) FILTER (is_reused) AS reused, count(*) FILTER (NOT is_reused) AS fresh FROM v_media GROUP BY 1)
       SELECT p.*, r.input_type, v.verdict, round(v.confidence, 6) AS confidence, v.evidence_strength,
              coalesce(m.reused, 0) AS reused_media_count, coalesce(m.fresh, 0) AS unverified_media_count, v.limitations
       FROM pages p JOIN v_requests r ON p.request_id = r.request_id JOIN v_verdicts v ON p.request_id = v.request_id
       LEFT JOIN media m ON p.request_id = m.request_id)""",
)
def result_documents(spark, sf):
    """Nested documents of all requests in pages of two, shown by the ids they hold (a page
    of fact checks alone has no id to show)."""
    t = _stored(spark, sf)
    requests = v.requests(spark, sf).select("request_id", "input_type")
    docs = rs.result_documents(
        requests, t["claims"], t["verdicts"], t["evidence"], t["sources"], t["fact_checks"], t["media"], page_items=2
    )
    shown = ("claims", "supporting_evidence", "contradicting_evidence", "neutral_evidence", "source_analysis")
    lists = [F.size(c) for c in shown] + [F.size("media_analysis.images"), F.size("media_analysis.videos")]
    docs = docs.where((F.col("page") == 0) | (sum(lists[1:], lists[0]) > 0))

    def ids(name: str, item: str):
        return F.array_join(F.transform(name, lambda s: s[item].cast("string")), " | ")

    m = F.col("media_analysis")
    return docs.select(
        "request_id",
        "page",
        "input_type",
        "verdict",
        F.round("confidence", 6).alias("confidence"),
        "evidence_strength",
        ids("claims", "claim_id").alias("claim_ids"),
        ids("supporting_evidence", "evidence_id").alias("supporting_ids"),
        ids("contradicting_evidence", "evidence_id").alias("contradicting_ids"),
        ids("neutral_evidence", "evidence_id").alias("neutral_ids"),
        ids("source_analysis", "source_id").alias("source_ids"),
        ids("primary_sources", "source_id").alias("primary_ids"),
        F.size(m["images"]).alias("images"),
        F.size(m["videos"]).alias("videos"),
        m["reused_media_count"].alias("reused_media_count"),
        m["unverified_media_count"].alias("unverified_media_count"),
        F.array_join("limitations", "; ").alias("limitations"),
    )


@query(
    "stored_request",
    "SELECT kind, count(*) AS n_rows FROM (SELECT 'claims' AS kind FROM v_claims WHERE request_id = 3 UNION ALL SELECT 'evidence' FROM v_evidence WHERE request_id = 3 UNION ALL SELECT 'sources' FROM v_sources WHERE request_id = 3 UNION ALL SELECT 'media' FROM v_media WHERE request_id = 3) GROUP BY kind",
)
def stored_request(spark, sf):
    """All stored rows of one request: the run is committed twice, which stores it once, and read back by id."""
    names = {"claims": "claims", "evidence": "evidence", "sources": "sources", "media": "media_items"}
    stored = _stored(spark, sf)
    root = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    for _ in range(2):
        committed.commit(spark, root, "first", {table: stored[n] for n, table in names.items()})
    found = committed.read_result(spark, root, 3)
    parts = [found[table].select(F.lit(n).alias("kind")) for n, table in names.items()]
    return news_files.union_all(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "history_page",
    "SELECT request_id, input_type, substr(original_text, 1, 200) AS original_text, status FROM v_requests ORDER BY created_at DESC, request_id LIMIT 20 OFFSET 10",
)
def history_page(spark, sf):
    rows = rs.history_page(v.requests(spark, sf), skip=10, limit=20)
    return rows.select("request_id", "input_type", "original_text", "status")


@query(
    "cascade_delete",
    """SELECT kind, count(*) AS n_rows FROM (
         SELECT 'requests' AS kind, request_id FROM v_requests UNION ALL SELECT 'claims', request_id FROM v_claims
         UNION ALL SELECT 'evidence', request_id FROM v_evidence UNION ALL SELECT 'media', request_id FROM v_media)
       WHERE request_id NOT IN (SELECT request_id FROM v_requests WHERE status = 'failed') GROUP BY kind""",
)
def cascade_delete(spark, sf):
    """Failed requests and everything that belongs to them leave the store; untouched files stay."""
    requests = v.requests(spark, sf).drop("original_text")
    names = {"requests": "verification_requests", "claims": "claims", "evidence": "evidence", "media": "media_items"}
    tables = {
        "verification_requests": requests,
        "claims": v.claims(spark, sf),
        "evidence": v.evidence_items(spark, sf),
        "media_items": v.media(spark, sf),
    }
    root = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    committed.commit(spark, root, "first", tables)
    failed = committed.read_table(spark, root, "verification_requests").filter("status = 'failed'")
    committed.delete_requests(spark, root, "failed-out", failed)
    parts = [committed.read_table(spark, root, table).select(F.lit(n).alias("kind")) for n, table in names.items()]
    return news_files.union_all(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "media_summary",
    """SELECT request_id, count(*) FILTER (media_type = 'image') AS images, count(*) FILTER (media_type = 'video') AS videos,
              count(*) FILTER (is_reused) AS reused_media_count, count(*) FILTER (NOT is_reused) AS unverified_media_count FROM v_media GROUP BY 1""",
)
def media_summary(spark, sf):
    return rs.media_summary(v.media(spark, sf))


@query(
    "dashboard_verdicts",
    "SELECT count(*) AS total_checks, "
    + ", ".join(f"count(*) FILTER (verdict = '{n}') AS {'false_count' if n == 'false' else n}" for n in rules.VERDICTS)
    + " FROM v_verdicts",
)
def dashboard_verdicts(spark, sf):
    return rs.verdict_totals(_run(spark, sf).verdicts)


@query("dashboard_categories", "SELECT category, count(*) AS n_rows FROM v_claims GROUP BY 1")
def dashboard_categories(spark, sf):
    return rs.distribution(v.claims(spark, sf), "category")


@query("dashboard_source_types", "SELECT source_type, count(*) AS n_rows FROM v_sources GROUP BY 1")
def dashboard_source_types(spark, sf):
    return rs.distribution(v.sources(spark, sf), "source_type")


@query(
    "dashboard_averages",
    """SELECT round((SELECT avg(confidence) FROM v_verdicts), 6) AS average_confidence,
              round((SELECT count(*) FROM v_sources) / (SELECT count(*) FROM v_verdicts)::DOUBLE, 6) AS average_sources_per_check,
              round((SELECT count(*) FROM v_sources WHERE source_type = 'primary') / (SELECT count(*) FROM v_sources WHERE source_type = 'secondary')::DOUBLE, 6) AS primary_secondary_ratio""",
)
def dashboard_averages(spark, sf):
    run = _run(spark, sf)
    return rs.dashboard_averages(run.verdicts, run.sources)
