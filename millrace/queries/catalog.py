"""One query per operator over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import text, urls
from millrace.operators import cache, classify, corpus, dedup, domains, extract, ranking, tiers
from millrace.plans import fetch, report, search
from millrace.queries import sql as S
from millrace.queries.tables import as_of, benchmark_queries, entries, events, outcomes, page_pool, page_rows, ranking_pool, refusals, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PREFER = ["example.com", "example.org"]
AGE = "(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts))"


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- URLs ----


@query(f"SELECT page_id, {S.canonical_url('url')} AS canonical FROM pages")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {S.search_domain('url')} AS search_domain, {S.health_domain('url')} AS health_domain FROM pages")
def domain_key(spark, d):
    return table(spark, d, "pages").select("page_id", urls.search_domain(F.col("url")).alias("search_domain"), urls.health_domain(F.col("url")).alias("health_domain"))


@query("SELECT page_id, regexp_matches(lower(trim(url)), '^https?://[^/?#]+') AS valid FROM pages")
def valid_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.valid_url(F.col("url")).alias("valid"))


_VIDEOS = [
    ("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ?si=x", "dQw4w9WgXcQ"),
    ("https://m.youtube.com/shorts/abcdefghijk", "abcdefghijk"), ("https://www.youtube.com/embed/abcdefghij_/x", "abcdefghij_"),
    ("https://youtube.com/live/a-b-c-d-e-f", "a-b-c-d-e-f"), ("https://youtube.com.evil.net/watch?v=dQw4w9WgXcQ", ""),
    ("https://www.youtube.com/watch?v=short", ""), ("https://example.com/watch?v=dQw4w9WgXcQ", ""), ("https://www.youtube.com/channel/abcdefghijk", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({S.quoted(u)}, {S.quoted(v)})" for u, v in _VIDEOS) + ") AS t(url, video)")
def video_id(spark, d):
    rows = spark.createDataFrame([(u,) for u, _ in _VIDEOS], "url string")
    return rows.select("url", urls.video_id(F.col("url")).alias("video"))


@query(f"""SELECT url, pos, label, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href AS target FROM (
  SELECT url, unnest(range(len(h))) AS pos, trim(unnest(h)) AS href, {S.collapsed(S.decoded("regexp_replace(unnest(l), '<[^>]*>', ' ', 'g')"))} AS label
  FROM (SELECT url, regexp_extract_all(html, {S.quoted(extract.ANCHOR)}, 1) AS h, regexp_extract_all(html, {S.quoted(extract.ANCHOR)}, 2) AS l FROM pages))
  WHERE href <> '' AND label <> '' AND NOT regexp_matches(lower(href), '^(#|javascript:|mailto:|tel:)')""")
def page_links(spark, d):
    rows = extract.anchors(table(spark, d, "pages"))
    return rows.select("url", F.col("pos").cast("long").alias("pos"), "label", "target")


# ---- text ----


@query(f"SELECT page_id, {S.title_key(S.page_title('html'))} AS title_key FROM pages")
def title_key(spark, d):
    return table(spark, d, "pages").select("page_id", text.title_key(text.page_title(F.col("html"))).alias("title_key"))


@query(f"SELECT doc_id, {S.cut('t', 600)} AS tidy FROM (SELECT doc_id, {S.tidy('text')} AS t FROM documents)")
def tidy_prose(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tidy(F.col("text"), 600).alias("tidy"))


@query(f"""SELECT doc_id, {S.cut('t', 2000)} AS tidy FROM (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(
  list_transform(string_split(text, chr(10)), lambda l: {S.collapsed('l')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS t FROM documents)""")
def tidy_structured(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tidy_structured(F.col("text"), 2000).alias("tidy"))


@query("SELECT doc_id, substr(text, 1, 3500) AS clipped, length(substr(text, 1, 3500)) AS chars FROM documents")
def clip_text(spark, d):
    out = table(spark, d, "documents").select("doc_id", text.clip(F.col("text"), 3500).alias("clipped"))
    return out.withColumn("chars", F.length("clipped").cast("long"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def tokens(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


_PASSAGES = f"""SELECT doc_id, i, substr(sha256(concat_ws('|', 'doc/' || doc_id, 'default', i)), 1, 24) AS id, x AS text FROM (
  SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i FROM (
    SELECT doc_id, s, substr(t, s + 1, 1200) AS x FROM (
      SELECT doc_id, t, unnest(generate_series(0, greatest(length(t) - 1, 0), 1000)) AS s FROM (SELECT doc_id, {S.collapsed('text')} AS t FROM documents)))
  WHERE length(x) > 120)"""


def _document_passages(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("title"), "text")
    return corpus.passages(docs).withColumn("doc_id", F.substring("url", 5, 20).cast("long"))


@query(_PASSAGES)
def passages(spark, d):
    return _document_passages(spark, d).select("doc_id", F.col("i").cast("long").alias("i"), "id", "text")


_WORDS = f"regexp_extract_all(lower(text), {S.quoted(text.WORD)})"


@query(f"""SELECT doc_id, n, coalesce(round(latin / nullif(n, 0), 6), 0) AS ratio, n >= 15 AND latin / nullif(n, 0) > 0.04 AS latin, n >= 15 AND french / nullif(n, 0) > 0.06 AS french FROM (
  SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN {S.in_list(text.FRENCH + text.ENGLISH)})) AS latin, len(list_filter(w, lambda x: x IN {S.in_list(text.FRENCH)})) AS french
  FROM (SELECT doc_id, {_WORDS} AS w FROM documents))""")
def function_word_ratio(spark, d):
    n, hits = text.function_words(F.col("text"), text.FRENCH + text.ENGLISH)
    false = F.lit(False)
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("n"), F.coalesce(F.round(F.try_divide(hits, n), 6), F.lit(0.0)).alias("ratio"), F.coalesce(text.looks_latin(F.col("text")), false).alias("latin"), F.coalesce(text.looks_french(F.col("text")), false).alias("french"))


@query(f"SELECT page_id, {S.page_title('html')} AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {S.floor_text('html')} AS text FROM pages")
def page_text_floor(spark, d):
    return page_rows(spark, d).select("page_id", "text")


@query(f"SELECT page_id, {S.container_text('html')} AS text FROM pages")
def page_text_container(spark, d):
    return table(spark, d, "pages").select("page_id", extract.container_text(F.col("html")).alias("text"))


@query(f"""SELECT page_id, CASE WHEN length(html) < 200 THEN 'empty_html' WHEN length(t) < 220 THEN 'no_prose' WHEN length(t) < 600 THEN 'thin' ELSE 'ok' END AS status
  FROM (SELECT page_id, html, {S.floor_text('html')} AS t FROM pages)""")
def thin_status(spark, d):
    return page_rows(spark, d).select("page_id", classify.extraction_status(F.col("html"), F.col("text")).alias("status"))


@query(f"""SELECT url, arg_max(tier, chars * 10 - pos) AS tier, max(chars) AS chars FROM (
  SELECT url, 'container' AS tier, length({S.container_text('html')}) AS chars, 0 AS pos FROM pages
  UNION ALL SELECT url, 'floor', length({S.floor_text('html')}), 1 FROM pages) GROUP BY url""")
def best_thin(spark, d):
    pages = table(spark, d, "pages")
    rungs = F.array(F.struct(F.lit("container").alias("tier"), F.length(extract.container_text(F.col("html"))).alias("chars"), F.lit(0).alias("pos")), F.struct(F.lit("floor").alias("tier"), F.length(extract.floor_text(F.col("html"))).alias("chars"), F.lit(1).alias("pos")))
    out = classify.best_thin(pages.select("url", F.explode(rungs).alias("r")).select("url", "r.*"))
    return out.select("url", "tier", F.col("chars").cast("long").alias("chars"))


@query(f"""SELECT conv_id, substr({S.collapsed("string_agg(t, ' ' ORDER BY turn)")}, 1, 20000) AS prose FROM (SELECT conv_id, turn, trim(text) AS t FROM conversations)
  WHERE t <> '' AND NOT (starts_with(t, '[') AND ends_with(t, ']')) GROUP BY conv_id""")
def caption_prose(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return turns.select("conv_id", text.captions(F.transform("x", lambda y: y["text"])).alias("prose")).filter("prose <> ''")


@query()
def extract_cascade(spark, d):
    return extract.extract(table(spark, d, "pages")).select("page_id", "ok", "tier", "title", "chars", "reason")


@query()
def extract_links(spark, d):
    return extract.links(table(spark, d, "pages")).select("page_id", "links")


# ---- ranking ----

_RANK_POOL = f"""SELECT q.query_id, p.* FROM (SELECT page_id AS input_pos, url, {S.page_title('html')} AS title, substr({S.floor_text('html')}, 1, 240) AS text,
  CASE WHEN page_id % 7 <> 0 THEN page_id % 60 END AS day FROM pages) p CROSS JOIN (SELECT item_id AS query_id FROM benchmark WHERE item_id % 50 = 0) q"""


def _bm25_sql(factor: str) -> str:
    return f"""WITH pool AS ({_RANK_POOL}), toks AS (SELECT *, {S.tokens("title || ' ' || text")} AS tk FROM pool),
  terms AS (SELECT query_id, term, count(*) AS w FROM (SELECT item_id AS query_id, unnest({S.tokens('text')}) AS term FROM benchmark WHERE item_id % 50 = 0) WHERE length(term) > 2 GROUP BY ALL),
  stats AS (SELECT query_id, count(*) AS n, avg(len(tk)) AS mean FROM toks GROUP BY query_id),
  tf AS (SELECT query_id, input_pos, term, count(*) AS tf FROM (SELECT query_id, input_pos, unnest(tk) AS term FROM toks) JOIN terms USING (query_id, term) GROUP BY ALL),
  df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
  part AS (SELECT query_id, input_pos, w * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * greatest(len(tk), 1) / mean)) AS s
    FROM tf JOIN df USING (query_id, term) JOIN terms USING (query_id, term) JOIN stats USING (query_id) JOIN toks USING (query_id, input_pos)),
  total AS (SELECT query_id, input_pos, sum(s) AS s FROM part GROUP BY ALL)
  SELECT query_id, input_pos, url, title, round(coalesce(s, 0) * {factor}, 6) AS score FROM pool LEFT JOIN total USING (query_id, input_pos)"""


@query(_bm25_sql("1"))
def bm25_scores(spark, d):
    rows = ranking.bm25(ranking_pool(spark, d), benchmark_queries(spark, d))
    return rows.select("query_id", "input_pos", "url", "title", F.round("score", 6).alias("score"))


@query(_bm25_sql("(0.5 + 0.5 * CASE WHEN day IS NULL THEN 1 ELSE power(0.5, greatest(30 - day, 0) / 21.0) END)"))
def bm25_recency(spark, d):
    rows = ranking.bm25(ranking_pool(spark, d), benchmark_queries(spark, d), recency=0.5, as_of=as_of())
    return rows.select("query_id", "input_pos", "url", "title", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, url, title, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, input_pos) AS rank FROM ({_bm25_sql('1')})) WHERE rank <= 10")
def bm25_top(spark, d):
    rows = ranking.bm25(ranking_pool(spark, d), benchmark_queries(spark, d)).withColumn("score", F.round("score", 6))
    top = ranking.limited(rows, 10)
    return top.select("query_id", "url", "title", "score", F.col("rank_pos").cast("long").alias("rank"))


_POOL = f"SELECT {S.search_domain('url')} AS query_id, page_id AS input_pos, url, {S.page_title('html')} AS title FROM pages"
_BAND = f"CASE WHEN {S.junk_domain('url')} THEN 2 WHEN " + " OR ".join(f"{S.search_domain('url')} = '{p}' OR ends_with({S.search_domain('url')}, '.{p}')" for p in PREFER) + " THEN 0 ELSE 1 END"


@query(f"SELECT input_pos, band, row_number() OVER (PARTITION BY query_id ORDER BY band, input_pos) AS rank_pos FROM (SELECT *, {_BAND} AS band FROM (SELECT input_pos % 3 AS query_id, input_pos, url FROM ({_POOL})))")
def band_order(spark, d):
    pool = page_pool(spark, d).withColumn("query_id", F.col("input_pos") % 3)
    return ranking.banded(pool, PREFER).select("input_pos", "band", F.col("rank_pos").cast("long").alias("rank_pos"))


@query(f"SELECT input_pos, url FROM ({_POOL}) WHERE NOT {S.junk_domain('url')}")
def junk_filter(spark, d):
    return ranking.without_junk(page_pool(spark, d)).select("input_pos", "url")


@query(f"SELECT input_pos, url FROM (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY input_pos) AS n FROM (SELECT *, {S.canonical_url('url')} AS k FROM ({_POOL}))) WHERE n = 1 AND k <> ''")
def dedup_url(spark, d):
    return dedup.by_url(page_pool(spark, d)).select("input_pos", "url")


@query(f"""WITH RECURSIVE pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY input_pos) AS n FROM (
    SELECT query_id, input_pos, {S.canonical_url('url')} AS k, {S.title_key('title')} AS t FROM ({_POOL})) WHERE k <> ''),
  walk AS (SELECT query_id, 0::BIGINT AS n, []::VARCHAR[] AS ks, []::VARCHAR[] AS ts, NULL::BIGINT AS kept FROM (SELECT DISTINCT query_id FROM pool)
    UNION ALL SELECT w.query_id, p.n,
      CASE WHEN NOT list_contains(ks, k) AND NOT (length(t) >= 25 AND list_contains(ts, t)) THEN list_append(ks, k) ELSE ks END,
      CASE WHEN NOT list_contains(ks, k) AND length(t) >= 25 AND NOT list_contains(ts, t) THEN list_append(ts, t) ELSE ts END,
      CASE WHEN NOT list_contains(ks, k) AND NOT (length(t) >= 25 AND list_contains(ts, t)) THEN p.input_pos END
    FROM walk w JOIN pool p ON p.query_id = w.query_id AND p.n = w.n + 1)
  SELECT kept AS input_pos FROM walk WHERE kept IS NOT NULL""")
def dedup_greedy(spark, d):
    return dedup.greedy(page_pool(spark, d)).select("input_pos")


@query(f"SELECT query_id, input_pos, url FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(title) DESC, input_pos) AS n FROM ({_POOL})) WHERE n <= 2")
def per_url_cap(spark, d):
    return dedup.capped(page_pool(spark, d), "query_id", 2, F.length("title").desc(), "input_pos").select("query_id", "input_pos", "url")


_TRUSTED = " OR ".join(f"{S.search_domain('url')} = '{p}' OR ends_with({S.search_domain('url')}, '.{p}')" for p in PREFER)


@query(f"SELECT query_id, round(avg(CASE WHEN {_TRUSTED} THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN {_TRUSTED} THEN 1.0 ELSE 0.0 END) < 0.35 AS sweep FROM (SELECT input_pos % 3 AS query_id, url FROM ({_POOL})) GROUP BY query_id")
def trusted_share(spark, d):
    pool = page_pool(spark, d).withColumn("query_id", F.col("input_pos") % 3)
    return ranking.trusted_share(pool, PREFER).select("query_id", F.round("share", 6).alias("share"), "sweep")


# Rows of a stated source: the pages themselves, found again under each domain that they lie on.
SWEEP = ["example.org"]
_ON = f"({S.search_domain('url')} = '{SWEEP[0]}' OR ends_with({S.search_domain('url')}, '.{SWEEP[0]}'))"
_SWEPT = f"""WITH pool AS (SELECT input_pos, input_pos % 3 AS query_id, url FROM ({_POOL})),
  short AS (SELECT query_id, max(input_pos) AS last FROM pool GROUP BY query_id HAVING avg(CASE WHEN {_ON} THEN 1.0 ELSE 0.0 END) < 0.35),
  found AS (SELECT s.query_id, s.last, p.url, regexp_replace(split_part(p.url, '?', 1), '/+$', '') AS key, p.page_id FROM short s, pages p WHERE {_ON.replace('url', 'p.url')}),
  fresh AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY page_id) AS n FROM found f
    WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM pool q WHERE q.query_id = f.query_id AND {S.canonical_url('q.url')} = f.key))
  SELECT query_id, key FROM fresh WHERE n = 1"""


@query(_SWEPT)
def sweep_rows(spark, d):
    """The rows that a sweep adds, by their weaker key."""
    pool = page_pool(spark, d).withColumn("query_id", F.col("input_pos") % 3)
    pages = table(spark, d, "pages").select(F.col("page_id").alias("input_pos"), "url", F.lit("").alias("title"), F.lit(True).alias("swept"))
    queries = spark.createDataFrame([(k, f"query {k}") for k in range(3)], "query_id long, query string")
    rows = search.swept(pool, queries, SWEEP, lambda asked: pages.crossJoin(F.broadcast(asked.select("query_id", "domain"))))  # a stated, short list against all rows
    key = F.regexp_replace(F.substring_index(F.col("url"), "?", 1), "/+$", "")
    return rows.filter("swept").select("query_id", key.alias("key"))


@query(f"SELECT {S.search_domain('url')} AS source, count(*) AS rows FROM pages GROUP BY 1")
def source_counts(spark, d):
    return page_pool(spark, d).groupBy(F.col("query_id").alias("source")).agg(F.count(F.lit(1)).alias("rows"))


# ---- corpus ----

_COSINE = """SELECT query_id, id, url, score, rank_pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY score DESC, id) AS n FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS id, 'page/' || e.label AS url, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
    FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q {scope}) WHERE score >= 0.22) WHERE n <= 2) WHERE rank_pos <= 10"""


def _cosine(spark, d, scope):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("page/"), F.col("label").cast("string")).alias("url"), F.col("embedding").alias("vec"))
    queries = rows.filter(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "vec")
    found = corpus.similar(rows, queries, domains=scope)
    return found.select("query_id", "id", "url", F.round("score", 6).alias("score"), F.col("rank_pos").cast("long").alias("rank_pos"))


@query(_COSINE.format(scope=""))
def cosine_topk(spark, d):
    return _cosine(spark, d, None)


@query(_COSINE.format(scope="WHERE e.label IN (1, 2)"))
def cosine_scoped(spark, d):
    return _cosine(spark, d, ["page/1", "page/2"])


@query(f"""WITH pool AS (SELECT {S.search_domain('url')} AS query_id, {S.canonical_url('url')} AS url FROM pages), hits AS (SELECT {S.search_domain('url')} AS query_id, url FROM pages)
  SELECT query_id, url, FALSE AS from_corpus FROM pool UNION ALL SELECT query_id, url, TRUE FROM hits WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.query_id = hits.query_id AND p.url = hits.url)""")
def corpus_anti_merge(spark, d):
    pool = page_pool(spark, d)
    hits = pool.select("query_id", "url", F.lit(0.5).alias("score"), F.col("title").alias("text"))
    return corpus.merged(pool.withColumn("url", urls.canonical_url(F.col("url"))), hits).select("query_id", "url", "from_corpus")


@query(f"SELECT id, doc_id FROM ({_PASSAGES}) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def corpus_new_chunks(spark, d):
    found = _document_passages(spark, d)
    stored = found.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return corpus.unstored(found, stored).select("id", "doc_id")


def _event_corpus(spark, d):
    return events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("model"), F.col("user_id").alias("url"), "ts")


@query("SELECT event_type AS model, count(*) AS passages, count(DISTINCT user_id) AS urls FROM events GROUP BY 1")
def corpus_stats(spark, d):
    return corpus.statistics(_event_corpus(spark, d))


@query(f"SELECT id, model FROM (SELECT event_id AS id, event_type AS model, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events WHERE {AGE} <= 20 * 86400000000) WHERE n <= 1000")
def corpus_prune(spark, d):
    return corpus.retained(_event_corpus(spark, d), as_of(), days=20, most=1000).select("id", "model")


@query(f"SELECT event_type AS model, count(*) FILTER (WHERE {AGE} > 20 * 86400000000) AS expired, count(*) FILTER (WHERE {AGE} <= 20 * 86400000000) AS total, greatest(count(*) FILTER (WHERE {AGE} <= 20 * 86400000000) - 50, 0) AS over FROM events GROUP BY 1")
def corpus_prune_counts(spark, d):
    return corpus.prune_counts(_event_corpus(spark, d), as_of(), days=20, most=50)


# ---- cache ----

_ENTRIES = "SELECT CASE event_type WHEN 'signup' THEN 'search' WHEN 'view' THEN 'extract' WHEN 'click' THEN 'robots' WHEN 'purchase' THEN 'fetch' ELSE 'other' END AS kind, user_id AS key, ts, event_id AS seq, props AS value FROM events"
_LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY ts DESC, seq DESC) AS n FROM ({_ENTRIES})) WHERE n = 1"
_TTL = "CASE kind WHEN 'search' THEN 21600 WHEN 'extract' THEN 1814400 WHEN 'fetch' THEN 1814400 WHEN 'robots' THEN 86400 ELSE 3600 END"


@query(f"SELECT kind, key, seq, value FROM ({_LATEST})")
def cache_latest(spark, d):
    return cache.latest(entries(spark, d)).select("kind", "key", "seq", "value")


@query(f"SELECT kind, key, seq FROM ({_ENTRIES}) WHERE {AGE} / 1e6 <= {_TTL}")
def cache_ttl(spark, d):
    return cache.fresh(entries(spark, d), as_of()).select("kind", "key", "seq")


@query(f"SELECT kind, count(*) AS entries FROM ({_ENTRIES}) GROUP BY kind")
def cache_stats(spark, d):
    return cache.statistics(entries(spark, d))


@query(f"SELECT kind, key, seq FROM ({_ENTRIES}) WHERE {AGE} <= 10 * 86400000000")
def cache_purge(spark, d):
    return cache.purged(entries(spark, d), as_of(), days=10).select("kind", "key", "seq")


@query(f"""WITH asked AS (SELECT DISTINCT 'extract' AS kind, user_id AS key FROM events), good AS (SELECT kind, key, value FROM ({_LATEST}) WHERE {AGE} / 1e6 <= {_TTL})
  SELECT kind, key, value, value IS NOT NULL AS hit FROM asked LEFT JOIN good USING (kind, key)""")
def cache_lookup(spark, d):
    asked = events(spark, d).select(F.lit("extract").alias("kind"), F.col("user_id").alias("key")).distinct()
    return cache.lookup(asked, entries(spark, d), as_of())


@query(f"""WITH asked AS (SELECT DISTINCT 'extract' AS kind, user_id AS key FROM events), good AS (SELECT kind, key, value FROM ({_LATEST}) WHERE {AGE} / 1e6 <= {_TTL})
  SELECT count(value) AS hits, count(*) AS total, round(count(value) / count(*), 3) AS rate FROM asked LEFT JOIN good USING (kind, key)""")
def cache_hit_rate(spark, d):
    return cache.hit_rate(cache_lookup(spark, d))


# ---- domains ----

_RECORD = f"SELECT domain, sum(CASE WHEN good THEN w ELSE 0 END) AS ok, sum(CASE WHEN good THEN 0 ELSE w END) AS fail FROM (SELECT user_id AS domain, event_type <> 'error' AS good, power(0.5, greatest(0, {AGE} / 86400e6) / 14.0) AS w FROM events) GROUP BY domain"


@query(f"SELECT domain, round(ok, 6) AS ok, round(fail, 6) AS fail FROM ({_RECORD})")
def domain_decay(spark, d):
    return domains.decayed(outcomes(spark, d), as_of()).select("domain", F.round("ok", 6).alias("ok"), F.round("fail", 6).alias("fail"))


@query(f"SELECT domain, round((ok + 1) / (ok + fail + 2), 6) AS score, ok + fail >= 5 AND (ok + 1) / (ok + fail + 2) < 0.75 AS is_poor FROM ({_RECORD})")
def domain_score(spark, d):
    return domains.scored(domains.decayed(outcomes(spark, d), as_of()), floor=0.75).select("domain", F.round("score", 6).alias("score"), "is_poor")


@query(f"SELECT domain, round(ok, 2) AS ok, round(fail, 2) AS fail, round((ok + 1) / (ok + fail + 2), 3) AS score, ok + fail >= 5 AND (ok + 1) / (ok + fail + 2) < 0.3 AS is_poor FROM ({_RECORD}) WHERE ok + fail >= 0.5 ORDER BY score, domain LIMIT 20")
def domain_report(spark, d):
    return domains.report(domains.decayed(outcomes(spark, d), as_of()))


_HOSTS = f"SELECT domain, n >= 5 AND (good + 1) / (n + 2) < 0.5 AS is_poor FROM (SELECT {S.health_domain('url')} AS domain, count(*) AS n, count(*) FILTER (length(html) > 4000) AS good FROM pages GROUP BY 1)"


@query(f"""SELECT input_pos, coalesce(is_poor, FALSE) AS is_poor, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(is_poor, FALSE), input_pos) AS final_pos
  FROM (SELECT page_id % 3 AS query_id, page_id AS input_pos, {S.health_domain('url')} AS domain FROM pages) LEFT JOIN ({_HOSTS}) USING (domain)""")
def domain_order(spark, d):
    pages = table(spark, d, "pages")
    record = pages.groupBy(urls.health_domain(F.col("url")).alias("domain")).agg(F.sum((F.length("html") > 4000).cast("double")).alias("ok"), F.sum((F.length("html") <= 4000).cast("double")).alias("fail"))
    pool = pages.select((F.col("page_id") % 3).alias("query_id"), F.col("page_id").alias("input_pos"), F.col("page_id").alias("rank_pos"), "url")
    out = ranking.poor_last(pool, domains.scored(record, floor=0.5).select("domain", "is_poor"))
    return out.select("input_pos", "is_poor", F.col("final_pos").cast("long").alias("final_pos"))


# ---- tiers and engines ----


@query("""SELECT user_id AS engine, count(*) AS fails, max(ts) AS at FROM events WHERE event_type = 'error' GROUP BY 1""")
def engine_failures(spark, d):
    log = events(spark, d).filter("event_type = 'error'").select(F.col("user_id").alias("engine"), "ts", F.col("event_id").alias("seq"), F.col("props").alias("reason"))
    return tiers.failures(log).select("engine", "fails", F.col("at").cast("timestamp_ntz").alias("at"))


@query("""WITH r AS (SELECT user_id AS engine, max(CASE WHEN event_type = 'error' THEN ts END) AS last_at FROM events GROUP BY 1), t AS (
  SELECT engine, coalesce(epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(last_at) <= 2 * 86400000000, FALSE) AS tired FROM r)
  SELECT engine FROM t WHERE NOT tired OR (SELECT count(*) FROM t WHERE NOT tired) = 0""")
def engine_rest(spark, d):
    log = events(spark, d)
    failed = log.filter("event_type = 'error'").select(F.col("user_id").alias("engine"), "ts", F.col("event_id").alias("seq"), F.col("props").alias("reason"))
    engines = log.select(F.col("user_id").alias("engine")).distinct()
    return tiers.rested(engines, tiers.failures(failed), as_of("2024-01-30 00:00:00"), rest=2 * 86400.0)


_STRIKES = """SELECT tier, seq, ts, CASE WHEN refused THEN sum(refused::INT) OVER (PARTITION BY tier, run ORDER BY ts, seq) ELSE 0 END AS strikes FROM (
  SELECT *, sum((NOT refused)::INT) OVER (PARTITION BY tier ORDER BY ts, seq) AS run FROM (SELECT user_id AS tier, ts, event_id AS seq, event_type = 'error' AS refused FROM events))"""


@query(f"SELECT tier, seq, strikes::BIGINT AS strikes, CASE WHEN strikes > 0 THEN least(300 * power(2, least(strikes - 1, 20)), 3600) ELSE 0 END::DOUBLE AS rest FROM ({_STRIKES})")
def tier_cooldown(spark, d):
    return tiers.strikes(refusals(spark, d)).select("tier", "seq", F.col("strikes").cast("long").alias("strikes"), "rest")


@query(f"""SELECT tier, strikes::BIGINT AS strikes FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY ts DESC, seq DESC) AS n FROM ({_STRIKES}))
  WHERE n = 1 AND strikes > 0 AND epoch_us(TIMESTAMP '2024-01-30 00:00:00') < epoch_us(ts) + least(300 * power(2, least(strikes - 1, 20)), 3600) * 1000000""")
def tier_resting(spark, d):
    return tiers.resting(refusals(spark, d), as_of("2024-01-30 00:00:00")).select("tier", F.col("strikes").cast("long").alias("strikes"))


@query("""SELECT domain, seq, round(3600.0 * n + max(arrival - 3600.0 * n) OVER (PARTITION BY domain ORDER BY arrival, seq), 6) AS start FROM (
  SELECT user_id AS domain, event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)""")
def politeness_slots(spark, d):
    arrival = (F.unix_micros("ts") - F.unix_micros(as_of("2024-01-01 00:00:00"))) / 1e6
    rows = events(spark, d).select(F.col("user_id").alias("domain"), F.col("event_id").alias("seq"), arrival.alias("arrival"))
    return tiers.slots(rows, gap=3600.0).select("domain", "seq", F.round("start", 6).alias("start"))


@query("SELECT user_id AS tier, count(*) FILTER (epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(ts) < 86400000000) AS used FROM events GROUP BY 1")
def tier_budget_used(spark, d):
    return tiers.budget_used(refusals(spark, d), as_of("2024-01-30 00:00:00"), window=86400.0).select("tier", F.col("used").cast("long").alias("used"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS tier, event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  w AS (SELECT tier, 0::BIGINT AS n, NULL::BIGINT AS seq, []::DOUBLE[] AS used, FALSE AS granted FROM (SELECT DISTINCT tier FROM e)
    UNION ALL SELECT w.tier, e.n, e.seq, CASE WHEN len(list_filter(used, lambda t: e.at - t < 259200)) < 5 THEN list_append(list_filter(used, lambda t: e.at - t < 259200), e.at) ELSE list_filter(used, lambda t: e.at - t < 259200) END,
      len(list_filter(used, lambda t: e.at - t < 259200)) < 5 FROM w JOIN e ON e.tier = w.tier AND e.n = w.n + 1)
  SELECT tier, seq, granted FROM w WHERE n > 0""")
def rolling_budget(spark, d):
    at = (F.unix_micros("ts") - F.unix_micros(as_of("2024-01-01 00:00:00"))) / 1e6
    log = events(spark, d).select(F.col("user_id").alias("tier"), at.alias("at"), F.col("event_id").alias("seq"))
    return tiers.grants(log, budget=5, window=259200.0).select("tier", "seq", "granted")


# ---- responses and health (literal rows) ----

_ANSWERS = [
    (1, 403, "challenge", "", "challenge_needs_a_human", False), (2, 403, "", "<title>Just a moment...</title>", "challenge_needs_a_human", False),
    (3, 403, "", "forbidden", "http_403", True), (4, 200, "", "just a moment", "http_200", False), (5, 404, "", "", "http_404", False),
    (6, 429, "", "slow down", "http_429", True), (7, 503, "", "x" * 9000 + "cf-challenge", "http_503", True), (8, 500, "", "", "http_500", False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({a[0]}, '{a[4]}', {str(a[5]).upper()})" for a in _ANSWERS) + ") AS t(id, reason, refusal)")
def challenge_reason(spark, d):
    rows = spark.createDataFrame([x[:4] for x in _ANSWERS], "id int, status int, mitigated string, body string")
    reason = classify.http_reason(F.lit(""), F.col("status"), F.col("mitigated"), F.col("body"))
    return rows.select("id", reason.alias("reason")).withColumn("refusal", classify.is_refusal(F.col("reason")))


@query("SELECT 1 AS code, 'degraded: 1 dead, 1 degraded' AS message")
def health_verdict(spark, d):
    seen = spark.createDataFrame([("direct", "OK"), ("tls", "DEAD"), ("reader", "OFF")], "tier string, status string")
    sources = spark.createDataFrame([("web", "OK"), ("news", "DEGRADED")], "source string, status string")
    return classify.verdict(seen, sources)


@query("SELECT * FROM (VALUES ('a', 2::BIGINT, 1::BIGINT, 'OK'), ('b', 1, 0, 'DEGRADED'), ('c', 0, 0, 'DEAD'), ('d', 0, 0, 'OFF')) AS t(source, n, resolvable, status)")
def source_probe(spark, d):
    rows = [("a", True, 1, "https://x.org/1"), ("a", True, 1, ""), ("b", True, 1, "x"), ("c", True, None, None), ("d", False, None, None)]
    return classify.source_status(spark.createDataFrame(rows, "source string, configured boolean, found int, url string"))


@query("""SELECT round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS acc1 FROM (
  SELECT source, min(r) AS rank FROM (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id)) WHERE quality = 1 GROUP BY source)""")
def mrr_eval(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")))
    best = ranked.filter("quality = 1").groupBy("source").agg(F.min("r").alias("rank"))
    return report.evaluation(best).select(F.round("mrr", 6).alias("mrr"), F.round("acc1", 6).alias("acc1"))


@query("""WITH s AS (SELECT source, CAST(n_chars AS DOUBLE) AS score, quality = 1 AS good FROM documents JOIN labels USING (doc_id)),
  best AS (SELECT source, max(score) FILTER (WHERE good) AS g, max(score) FILTER (WHERE NOT good) AS b FROM s GROUP BY source),
  ranks AS (SELECT source, g, b, CASE WHEN g IS NOT NULL THEN 1 + (SELECT count(*) FROM s WHERE s.source = best.source AND NOT s.good AND s.score > best.g) END AS r FROM best)
  SELECT round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 6) AS acc1, round(avg(g - b), 6) AS margin FROM ranks""")
def retrieval_margin(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("query_id"), F.col("n_chars").cast("double").alias("score")).join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("right")), "doc_id")
    return report.margins(rows).select(*[F.round(x, 6).alias(x) for x in ("mrr", "acc1", "margin")])


@query("""WITH c AS (SELECT user_id, count(*) AS found, count(*) FILTER (WHERE event_type <> 'error') AS extracted, count(*) FILTER (WHERE event_type = 'view') AS thin, max(event_id) % 977 AS ms FROM events GROUP BY user_id), d AS (SELECT * FROM c WHERE user_id % 7 <> 0)
  SELECT (SELECT count(*) FROM c) AS cases, count(*) AS cases_with_results, CAST(sum(found) AS BIGINT) AS results_found, CAST(sum(extracted) AS BIGINT) AS pages_extracted, CAST(sum(thin) AS BIGINT) AS thin_extractions, round(sum(extracted) / sum(found), 3) AS extraction_rate, CAST(floor(median(ms)) AS BIGINT) AS median_ms FROM d""")
def benchmark_summary(spark, d):
    of = lambda name: F.count_if(F.col("event_type") == name)
    cases = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("event_type") != "error").alias("extracted"), of("view").alias("thin"), (F.max("event_id") % 977).alias("elapsed_ms"))
    return report.benchmark_summary(cases.withColumn("failed", F.col("user_id") % 7 == 0))


# ---- pipelines ----


@query()
def search_and_fetch(spark, d):
    """Every page as a pool row of each query of the stated set: ranked, cut to ten, extracted."""
    pages = table(spark, d, "pages").dropDuplicates(["url"])
    rows, _ = search.search_and_fetch(benchmark_queries(spark, d), [ranking_pool(spark, d)], pages, search.Options(limit=10, prefer=tuple(PREFER)))
    return rows.select("query_id", "rank_pos", "url", "title", F.round("score", 6).alias("score"), "quality", "content")


@query()
def fetch_pages(spark, d):
    pages = table(spark, d, "pages")
    return fetch.fetch(pages.select("url"), pages).select("url", "quality", "tier", "title", "content", "failure_reason")
