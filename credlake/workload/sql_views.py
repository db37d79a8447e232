"""The derived views as SQL text, for checking results with another engine."""
from __future__ import annotations

import re

from credlake.functions import rules, urls
from credlake.functions.cleaning import STOPWORDS
from credlake.functions.style import PUNCTUATION
from credlake.workload.views import HOSTS, MODELS, N_REQUESTS, TITLE_PREFIXES

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return ", ".join(text(v) for v in values)


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def words(x: str) -> str:
    """Words of a text without blank ones."""
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def has(x: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(v)})" for v in values) + ")"


def cases(rows: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in rows) + f" ELSE {default} END"


def pick(index: str, values: list[str]) -> str:
    """Value at a 0-based index, null beyond the list."""
    return f"list_extract([{listed(values)}], CAST({index} AS BIGINT) + 1)"


def bucket(key: str, seed: str, n: int) -> str:
    return f"(('0x' || substr(md5('{seed}' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % {n})"


def hash_number(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def combine(title: str, body: str) -> str:
    t, x = strip(title), strip(body)
    return f"CASE WHEN {t} <> '' AND {x} <> '' THEN {t} || '. ' || {x} ELSE {t} || {x} END"


def coerce(label: str) -> str:
    key = f"lower({strip(label)})"
    return (
        f"CASE WHEN {key} IN ('fake', 'false', 'unreliable') THEN 1 "
        f"WHEN {key} IN ('real', 'true', 'reliable') THEN 0 "
        f"WHEN regexp_full_match({key}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN "
        f"CASE TRY_CAST({key} AS DOUBLE) WHEN 1 THEN 1 WHEN 0 THEN 0 END END"
    )


def decode(label: str) -> str:
    return f"CASE {label} WHEN 1 THEN 'FAKE' WHEN 0 THEN 'REAL' END"


def level(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'Unknown' WHEN {x} >= 0.85 THEN 'High' "
        f"WHEN {x} >= 0.65 THEN 'Medium' ELSE 'Low' END"
    )


def normalized(x: str) -> str:
    """Cleaner up to the token split, for texts that need no Unicode step."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {text(entity)}, {text(char)})"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = f"regexp_replace({x}, 'https?://\\S+|www\\.\\S+', ' ', 'g')"
    word = "[\\p{L}\\p{N}_"
    x = f"regexp_replace({x}, '{word}.+-]+@{word}-]+\\.{word}.-]*{word}]', ' ', 'g')"
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return (
        f"list_filter(string_split({x}, ' '), lambda w: length(w) >= 2 AND w NOT IN ({listed(STOPWORDS)}))"
    )


def removed(x: str, pattern: str) -> str:
    return f"length(regexp_replace({x}, '{pattern}', '', 'g'))"


STYLE = {
    "word_count": "len({words})",
    "char_count": "length({x})",
    "sentence_count": "greatest(len(list_filter(string_split_regex({x}, '[.!?]+(?:\\s|$)'), "
    "lambda s: regexp_matches(s, '\\S'))), 1)",
    "avg_word_length": "round({letters} / len({words}), 4)",
    "uppercase_ratio": "CASE WHEN {alpha} = 0 THEN 0 ELSE round({upper} / {alpha}, 4) END",
    "punctuation_count": "length({x}) - length(translate({x}, {marks}, ''))",
    "url_count": "len(regexp_extract_all({x}, 'https?://\\S+|www\\.\\S+'))",
    "exclamation_count": "length({x}) - length(replace({x}, '!', ''))",
    "question_count": "length({x}) - length(replace({x}, '?', ''))",
}


def style(name: str, x: str) -> str:
    body = STYLE[name].format(
        x=x,
        words=words(x),
        letters=removed(x, "\\s+"),
        alpha=removed(x, "[^\\p{L}]+"),
        upper=removed(x, "[^\\p{Lu}]+"),
        marks=text(PUNCTUATION),
    )
    return f"CAST(CASE WHEN {strip(x)} = '' THEN 0 ELSE {body} END AS DOUBLE)"


def style_columns(x: str) -> str:
    return ", ".join(f"{style(n, x)} AS {n}" for n in STYLE)


def domain(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"


def source_type(host: str) -> str:
    return cases(
        [
            (has(host, urls.PIPELINE_GOVERNMENT), "'primary'"),
            (has(host, urls.PIPELINE_FACT_CHECK), "'fact_check'"),
            (has(host, urls.PIPELINE_EDUCATION), "'primary'"),
            (has(host, urls.PIPELINE_NEWS), "'secondary'"),
        ],
        "'unknown'",
    )


def analyzer_source_type(host: str) -> str:
    return cases(
        [
            (has(host, urls.ANALYZER_GOVERNMENT), "'primary'"),
            (has(host, urls.ANALYZER_EDUCATION), "'primary'"),
            (has(host, urls.ANALYZER_FACT_CHECK), "'fact_check'"),
            (has(host, urls.ANALYZER_ORGANISATIONS), "'primary'"),
        ],
        "'secondary'",
    )


def credibility(kind: str) -> str:
    return f"CAST(CASE {kind} WHEN 'primary' THEN 0.85 WHEN 'fact_check' THEN 0.8 WHEN 'secondary' THEN 0.7 ELSE 0.5 END AS DOUBLE)"


def relation(title: str) -> str:
    return cases(
        [(has(title, rules.CONTRADICT_WORDS), "'contradicts'"), (has(title, rules.SUPPORT_WORDS), "'supports'")],
        "'neutral'",
    )


def scan_relation(title: str) -> str:
    return cases(
        [(has(title, rules.SCAN_CONTRADICT_WORDS), "'contradicts'"), (has(title, rules.SCAN_SUPPORT_WORDS), "'supports'")],
        "NULL",
    )


def bucketed(score: str, position: int) -> str:
    rows = [(f"{score} >= {row[0]}", text(row[position])) for row in rules.VERDICT_BUCKETS]
    return cases(rows, text(rules.LOWEST_VERDICT[position - 1]))


VIEWS: dict[str, str] = {
    "news": """
        SELECT d.doc_id, split_part(d.text, '.', 1) AS title, d.text,
               CASE l.quality WHEN 0 THEN 'FAKE' WHEN 1 THEN 'REAL' END AS label, d.source, d.lang
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "coded": f"""
        SELECT doc_id, title, text, {coerce('label')} AS label, {combine('title', 'text')} AS content,
               source, lang FROM v_news""",
    "clean_news": f"""
        SELECT doc_id, title, text, label, content,
               CASE WHEN {bucket('doc_id', '42', 10000)} < 1500 THEN 'test'
                    WHEN {bucket('doc_id', '42', 10000)} < 3000 THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id) AS copy_no FROM v_coded
              WHERE label IS NOT NULL AND {strip('content')} <> '')
        WHERE copy_no = 1""",
    "tokenized": f"""
        SELECT doc_id, label, split, {tokens('n')} AS toks
        FROM (SELECT *, {normalized('content')} AS n FROM v_clean_news)""",
    "style_rows": f"SELECT doc_id, label, split, {style_columns('content')} FROM v_clean_news",
    "doc_terms": """
        SELECT doc_id, label, split, unnest(list_concat(toks,
               list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) AS term
        FROM v_tokenized""",
    "term_counts": "SELECT doc_id, label, split, term, count(*) AS n FROM v_doc_terms GROUP BY ALL",
    "term_stats": """
        SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM v_term_counts
        WHERE split = 'train' GROUP BY term""",
    "train_size": "SELECT count(*) AS n_docs FROM v_clean_news WHERE split = 'train'",
    "vocab": """
        SELECT row_number() OVER (ORDER BY term) - 1 AS idx, term, tf, df,
               ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf
        FROM (SELECT * FROM v_term_stats, v_train_size WHERE df >= 2 AND df <= 0.95::DOUBLE * n_docs
              ORDER BY tf DESC, term LIMIT 20000)""",
    "raw_weights": """
        SELECT doc_id, label, split, term, (1.0 + ln(n)) * idf AS w
        FROM v_term_counts JOIN v_vocab USING (term)""",
    "tfidf": """
        SELECT doc_id, label, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
        FROM v_raw_weights""",
    "style_long": """
        SELECT doc_id, label, split, feature, value FROM v_style_rows
        UNPIVOT (value FOR feature IN (word_count, char_count, sentence_count, avg_word_length,
                 uppercase_ratio, punctuation_count, url_count, exclamation_count, question_count))""",
    "ranges": """
        SELECT feature, min(value) AS lo, max(value) AS hi FROM v_style_long WHERE split = 'train'
        GROUP BY feature""",
    "scaled": """
        SELECT doc_id, label, split, feature,
               CASE WHEN hi = lo THEN least(1.0, greatest(0.0, value - lo))
                    ELSE least(1.0, greatest(0.0, (value - lo) / (hi - lo))) END AS value
        FROM v_style_long JOIN v_ranges USING (feature)""",
    "features": """
        SELECT doc_id, label, split, term AS feature, weight AS value FROM v_tfidf
        UNION ALL SELECT doc_id, label, split, feature, value FROM v_scaled""",
    "feature_list": """
        SELECT term AS feature FROM v_vocab UNION ALL SELECT DISTINCT feature FROM v_ranges""",
    "nb_sums": """
        SELECT f.feature, c.label, coalesce(sum(x.value), 0) + 1.0 AS s
        FROM v_feature_list f CROSS JOIN (VALUES (0), (1)) c(label)
        LEFT JOIN (SELECT * FROM v_features WHERE split = 'train') x
          ON x.feature = f.feature AND x.label = c.label
        GROUP BY ALL""",
    "nb_weights": """
        SELECT feature, max(share) FILTER (label = 1) - max(share) FILTER (label = 0) AS weight
        FROM (SELECT feature, label, ln(s) - ln(sum(s) OVER (PARTITION BY label)) AS share FROM v_nb_sums)
        GROUP BY feature""",
    "nb_bias": """
        SELECT ln(count(*) FILTER (label = 1)) - ln(count(*) FILTER (label = 0)) AS bias
        FROM v_clean_news WHERE split = 'train'""",
    "nb_scores": """
        SELECT d.doc_id, d.label, d.split,
               1.0 / (1.0 + exp(-(max(b.bias) + coalesce(sum(x.value * w.weight), 0)))) AS score
        FROM v_clean_news d CROSS JOIN v_nb_bias b
        LEFT JOIN v_features x ON x.doc_id = d.doc_id LEFT JOIN v_nb_weights w ON w.feature = x.feature
        GROUP BY d.doc_id, d.label, d.split""",
    "claims": f"""
        SELECT item_id AS claim_id, item_id % {N_REQUESTS} AS request_id, text,
               {pick(f'item_id % {len(rules.CATEGORIES)}', rules.CATEGORIES)} AS category,
               {pick('item_id % 3', ['high', 'medium', 'low'])} AS certainty_level
        FROM benchmark""",
    "page_results": f"""
        SELECT doc_id AS rank,
               coalesce('https://' || {pick('doc_id % 8', HOSTS)} || regexp_extract(url, '^https?://[^/]+(/[a-z]*)', 1), url) AS url,
               {pick('doc_id % 7', TITLE_PREFIXES)} || regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               CASE WHEN doc_id % 11 = 0 THEN 'Brief note' ELSE d.text END AS snippet,
               '2024-0' || CAST(doc_id % 9 + 1 AS VARCHAR) || '-15' AS published_date,
               CAST((doc_id % 100) / 100.0 AS DOUBLE) AS score,
               regexp_extract(url, '^https?://([^/]+)', 1) AS source_url
        FROM documents d JOIN pages ON page_id = d.doc_id % (SELECT count(*) FROM pages)""",
    "search_results": """
        SELECT rank % n AS claim_id, (rank // n) % 6 AS query_no, rank, url, title, snippet, published_date, score
        FROM v_page_results, (SELECT count(*) AS n FROM benchmark)""",
    "claim_queries": f"""
        SELECT claim_id, request_id, text, {words('text')} AS ws FROM v_claims""",
    "merged": """
        SELECT * EXCLUDE (copy_no) FROM (
          SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY query_no, rank) AS position
          FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, url ORDER BY query_no, rank) AS copy_no
                FROM v_search_results WHERE url <> '') WHERE copy_no = 1)
        JOIN (SELECT claim_id, CASE WHEN len(ws) > 5 THEN 30 ELSE 20 END AS cap FROM v_claim_queries) USING (claim_id)
        WHERE position <= cap""",
    "candidates": """
        SELECT c.claim_id, c.request_id, c.text AS claim_text, m.* EXCLUDE (claim_id)
        FROM v_claims c JOIN v_merged m ON c.claim_id = m.claim_id""",
    "all_sources": f"""
        SELECT md5(concat_ws('|', CAST(request_id AS VARCHAR), url)) AS source_id, *,
               {source_type('domain')} AS source_type
        FROM (SELECT *, {domain('url')} AS domain FROM v_candidates WHERE url <> '')""",
    "sources": f"""
        SELECT source_id, request_id, url, title, domain, source_type, domain AS publisher,
               published_date AS publication_date, {credibility('source_type')} AS credibility_score,
               true AS is_independent, claim_id, query_no, rank
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id, url ORDER BY claim_id, query_no, rank) AS copy_no
              FROM v_all_sources) WHERE copy_no = 1""",
    "evidence": """
        SELECT *, CAST(CASE WHEN relation = 'neutral' THEN 0.5 ELSE 0.6 END AS DOUBLE) AS confidence
        FROM (SELECT md5(concat_ws('|', CAST(claim_id AS VARCHAR), url)) AS evidence_id, request_id, claim_id,
                     md5(concat_ws('|', CAST(request_id AS VARCHAR), url)) AS source_id, url, title,
                     substr(snippet, 1, 500) AS text, """
    + relation("lower(title)")
    + """ AS relation FROM v_candidates WHERE length(snippet) >= 20)""",
    "evidence_scores": """
        SELECT e.*, s.source_type, greatest(0.0, least(100.0, 50.0
               + CASE WHEN s.source_id IS NULL THEN 0 ELSE
                   CASE s.source_type WHEN 'primary' THEN 30 WHEN 'secondary' THEN 10 WHEN 'fact_check' THEN 15 ELSE 0 END
                   + CASE WHEN s.is_independent THEN 20 ELSE 0 END
                   + CASE WHEN s.credibility_score > 0.8 THEN 10 WHEN s.credibility_score < 0.4 THEN -10 ELSE 0 END END
               + CASE e.relation WHEN 'contradicts' THEN -30 WHEN 'supports' THEN 10 WHEN 'partially_contradicts' THEN -15 ELSE 0 END
               ))::DOUBLE AS score
        FROM v_evidence e LEFT JOIN v_sources s ON e.source_id = s.source_id""",
    "request_ids": """
        SELECT event_id AS request_id FROM events JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)""",
    "counts": """
        SELECT r.request_id, coalesce(e.s, 0) AS s, coalesce(e.c, 0) AS c, coalesce(e.n, 0) AS n,
               coalesce(t.t, 0) AS t, coalesce(t.p, 0) AS p,
               coalesce(h.request_id % 5 = 0, false) AS ex, coalesce(h.request_id % 7 = 0, false) AS hc
        FROM v_request_ids r
        LEFT JOIN (SELECT request_id, count(*) FILTER (relation = 'supports') AS s,
                          count(*) FILTER (relation = 'contradicts') AS c,
                          count(*) FILTER (relation = 'neutral') AS n FROM v_evidence GROUP BY 1) e
               ON r.request_id = e.request_id
        LEFT JOIN (SELECT request_id, count(*) AS t, count(*) FILTER (source_type = 'primary') AS p
                   FROM v_sources GROUP BY 1) t ON r.request_id = t.request_id
        LEFT JOIN (SELECT DISTINCT request_id FROM v_claims) h ON r.request_id = h.request_id""",
    "verdict_scores": """
        SELECT *, greatest(0, least(100, 50 + 5 * s + 10 * p - 8 * c - 2 * n
               - CASE WHEN ex THEN 10 ELSE 0 END - CASE WHEN hc THEN 15 ELSE 0 END)) AS score FROM v_counts""",
    "verdicts": f"""
        SELECT *, CASE WHEN s = 0 AND c = 0 THEN 'unverified' ELSE {bucketed('score', 1)} END AS verdict,
               CASE WHEN s = 0 AND c = 0 THEN 'UNKNOWN' ELSE {bucketed('score', 2)} END AS evidence_strength,
               CAST(CASE WHEN s = 0 AND c = 0 THEN 0.3 ELSE least(0.99, 0.5 + (s + c) * 0.05) END AS DOUBLE) AS confidence,
               concat_ws('; ', CASE WHEN t < 3 THEN {text(rules.FEW_SOURCES)} END,
                         CASE WHEN p = 0 THEN {text(rules.NO_PRIMARY)} END,
                         CASE WHEN ex THEN {text(rules.EXAGGERATED)} END) AS limitations
        FROM v_verdict_scores""",
    "requests": f"""
        SELECT event_id AS request_id, {pick('event_id % 4', ['url', 'headline', 'article', 'claim'])} AS input_type,
               d.text AS original_text,
               CASE WHEN event_id % 10 = 9 THEN 'failed' ELSE 'processing' END AS status, ts AS created_at
        FROM events JOIN documents d ON d.doc_id = event_id % (SELECT count(*) FROM documents)""",
    "registry": f"""
        SELECT source_url, 'Site ' || source_url AS name, {pick('num % 3', ['FR', 'DE', 'US'])} AS country,
               coalesce({pick('num % 4', ['news', 'science', 'local'])}, 'news') AS category, language,
               {pick('num % 3', ['high', 'medium-high', 'medium'])} AS credibility,
               {pick('num % 2', ['news', 'article'])} AS list_kind, num AS seq
        FROM (SELECT *, {hash_number('source_url')} AS num FROM (
              SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS source_url,
                     min(regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1)) AS language
              FROM pages GROUP BY 1))""",
    "scan_articles": """
        SELECT rank AS article_id, CASE WHEN rank % 13 <> 0 THEN title ELSE '' END AS title,
               CASE WHEN rank % 13 <> 0 THEN snippet ELSE '' END AS snippet, url FROM v_page_results""",
    "scan_counts": f"""
        SELECT rank // 5 AS article_id, count(*) AS evidence_count,
               count(*) FILTER (rel = 'supports') AS supporting,
               count(*) FILTER (rel = 'contradicts') AS contradicting,
               count(DISTINCT rank % 2) AS claims_checked
        FROM (SELECT *, {scan_relation('lower(title)')} AS rel FROM v_page_results) GROUP BY 1""",
    "media": """
        SELECT event_id AS media_id, user_id AS request_id,
               CASE WHEN event_type IN ('click', 'view') THEN 'image' ELSE 'video' END AS media_type,
               value > 20 AS is_reused FROM events""",
    "predictions": f"""
        SELECT *, CASE WHEN prediction = 1 THEN score ELSE 1.0 - score END AS confidence
        FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction
        FROM (SELECT doc_id, label, model,
               floor((CASE WHEN label = 1 THEN sqrt(u) ELSE u END) * 1000.0) / 1000.0 AS score
        FROM (SELECT doc_id, label, model,
               CAST({hash_number("model || ':' || CAST(doc_id AS VARCHAR)")} AS DOUBLE) / 4294967296.0 AS u
        FROM v_coded, (SELECT unnest([{listed(MODELS)}]) AS model) WHERE label IS NOT NULL)))""",
    "confusion": """
        SELECT model, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
               count(*) FILTER (label = 0 AND prediction = 1) AS fp,
               count(*) FILTER (label = 1 AND prediction = 0) AS fn,
               count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM v_predictions GROUP BY model""",
    "curve": """
        SELECT model, score, pos, neg,
               sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp,
               sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS fp,
               sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg
        FROM (SELECT model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
              FROM v_predictions GROUP BY model, score)""",
}


# The documents to score: all news, every tenth one blank.
VIEWS["cut_clean_news"] = f"""
        SELECT doc_id, 0 AS label, '' AS split, {combine('title', 'text')} AS content
        FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN ' ' ELSE title END AS title,
                     CASE WHEN doc_id % 10 = 9 THEN '' ELSE text END AS text FROM v_news)"""
# The same feature and score views over them, in the space fitted on the training split.
CUT = ["tokenized", "style_rows", "doc_terms", "term_counts", "raw_weights", "tfidf", "style_long", "scaled", "features"]
for _name in CUT + ["nb_scores"]:
    VIEWS[f"cut_{_name}"] = re.sub(rf"\bv_({'|'.join(CUT)}|clean_news)\b", r"v_cut_\1", VIEWS[_name])


def with_views(sql: str) -> str:
    """The statement with a WITH clause for every view (``v_name``) it needs,
    dependencies first."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\bv_(\w+)", body):
            if name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"v_{n} AS ({VIEWS[n]})" for n in order) + "\n" + sql
