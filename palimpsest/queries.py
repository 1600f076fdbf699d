"""Queries over the driver's tables, each applying operators of this package, and DuckDB SQL for those that SQL can express.

The tables stand in for the real inputs: conversations for revision histories (a conversation is a page, a turn a
revision), pages for crawl snapshots, documents for page and source texts, events for things with a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import arrays, python, text
from palimpsest.operators import edits, filters, grounding, sampling, scoring
from palimpsest.pipeline import chain, funnel_counts
from palimpsest.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("page_id"), F.col("turn").cast("int").alias("seq"), "role", "text")
    return edits.revision_pairs(rows, order=["seq"])


PAIRS = "(SELECT * FROM (SELECT CAST(conv_id AS VARCHAR) AS page_id, CAST(turn AS INTEGER) AS seq, role, text AS tgt_text, lag(text) OVER w AS src_text, row_number() OVER w AS nth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE nth > 1)"


@query(f"SELECT page_id, seq, role, src_text, tgt_text FROM {PAIRS}")
def revision_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("page_id", "seq", "role", "src_text", "tgt_text")


@query(f"SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(tgt_text) - length(src_text)) AS BIGINT) AS grown FROM {PAIRS} WHERE length(src_text) >= 20 AND length(src_text) < 400 AND length(tgt_text) >= 20 AND length(tgt_text) < 400 GROUP BY role")
def pair_length_filter(spark, sf_dir):
    rows = chain(_pairs(spark, sf_dir), [filters.text_length(20, 400)])
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("tgt_text") - F.length("src_text")).cast("long").alias("grown"))


@query("SELECT CAST(conv_id AS VARCHAR) AS page_id, count(*) AS revisions, count(DISTINCT role) AS authors FROM conversations GROUP BY conv_id")
def revisions_per_page(spark, sf_dir):
    return edits.revision_counts(table(spark, sf_dir, "conversations").withColumn("page_id", F.col("conv_id").cast("string")), "page_id", "role")


@query("SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS carried FROM events")
def page_forward_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return chain(rows, [edits.forward_fill("mark", ["user_id"], ["ts", "event_id"], "carried")]).select("event_id", "user_id", F.coalesce("carried", F.lit(-1)).alias("carried"))


@query("SELECT doc_id, source FROM documents WHERE NOT (contains(text, 'on the') OR contains(text, 'License'))")
def title_containment_filter(spark, sf_dir):
    return chain(table(spark, sf_dir, "documents"), [filters.exclude_titles(["on the", "License"], "text")]).select("doc_id", "source")


@query("SELECT conv_id, turn FROM conversations WHERE length(text) > 0 AND NOT (contains(text, 'the ') OR contains(text, 'and'))")
def blocklist_filter(spark, sf_dir):
    steps = [filters.has_comment("text"), filters.comment_blocklist(["the ", "and"], "text")]
    return chain(table(spark, sf_dir, "conversations"), steps).select("conv_id", "turn")


@query("SELECT conv_id, turn, len(string_split(text, ' ')) AS n_tokens FROM conversations WHERE len(string_split(text, ' ')) >= 5 AND len(string_split(text, ' ')) < 40 AND length(text) >= 10 AND length(text) < 300")
def comment_token_length(spark, sf_dir):
    steps = [filters.comment_length(10, 300, "text"), filters.comment_token_length(5, 40, "text")]
    return chain(table(spark, sf_dir, "conversations"), steps).select("conv_id", "turn", F.size(F.split("text", " ", -1)).cast("long").alias("n_tokens"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\\r\\n]+', chr(10), 'g'), '[\\t \\x{a0}]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS cleaned FROM documents")
def clean_newlines(spark, sf_dir):
    rows = chain(table(spark, sf_dir, "documents"), [edits.clean_newlines(["text"])])
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("cleaned"))


@query(r"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents) GROUP BY token HAVING count(*) >= 5")
def regex_tokens_explode(spark, sf_dir):
    # Tokens are counted in each document first: what is shuffled is a row for each of its words, with two sums.
    rows = table(spark, sf_dir, "documents").select(F.explode(arrays.counted(text.words(F.lower("text")))).alias("own")).select("own.*")
    return rows.groupBy(F.col("value").alias("token")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).filter("n >= 5")


@query("SELECT page_id, CAST(len(h) AS BIGINT) AS n_links, array_to_string(h, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages)")
def href_extract(spark, sf_dir):
    links = text.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"))


@query(r"SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, count(*) AS n, min(url) AS first_url FROM pages GROUP BY 1")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url"))


_CANON = r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^[a-z][a-z0-9+.-]*://(www[0-9]*\.)?', '') AS bare FROM pages),
p AS (SELECT page_id, regexp_replace(regexp_replace(split_part(bare, '?', 1), '^([^/:]+):(80|443)(/|$)', '\1\3'), '/+$', '') AS path, array_to_string(list_sort(string_split(regexp_extract(bare, '\?(.*)$', 1), '&')), '&') AS query FROM u)
SELECT page_id, CASE WHEN query = '' THEN path ELSE path || '?' || query END AS canonical FROM p
"""


@query(_CANON)
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


DOMAINS = ["example.com", "news", "wiki", ".org"]


@query("SELECT page_id, url FROM pages WHERE contains(url, 'example.com') OR contains(url, 'news') OR contains(url, 'wiki') OR contains(url, '.org')")
def whitelist_substring(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("urls", F.array("url"))
    return chain(rows, [filters.domain_whitelist(DOMAINS, ["urls"])]).select("page_id", "url")


@query("SELECT page_id, NOT (ends_with(site, '.com') OR ends_with(site, '.uk') OR ends_with(site, '.org') OR ends_with(site, '.ca') OR ends_with(site, '.au') OR ends_with(site, '.nz') OR ends_with(site, '.net') OR contains(site, 'youtube.com')) AS valid FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^[a-z]+://[^/]+') ELSE url END AS site FROM pages)")
def valid_url(spark, sf_dir):
    site = F.when(F.col("page_id") % 3 == 0, F.regexp_extract("url", "^[a-z]+://[^/]+", 0)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.valid_url(site).alias("valid"))


def _html_text_sql(html: str) -> str:
    tags = f"regexp_replace(regexp_replace(regexp_replace({html}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        tags = f"replace({tags}, '{entity}', {char})"
    return rf"trim(regexp_replace({tags}, '[\t \r\n\x{{a0}}]+', ' ', 'g'))"


_HTML = f"SELECT page_id, md5({_html_text_sql('html')}) AS text_md5 FROM pages"
_ARTICLE = r"""(SELECT page_id, url, CASE WHEN inside <> '' THEN inside ELSE outside END AS html FROM (SELECT page_id, url, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS inside,
  regexp_replace(html, '(?is)<(nav|aside|header|footer|form)[^>]*>.*?</(nav|aside|header|footer|form)>', ' ', 'g') AS outside FROM pages))"""


@query(_HTML)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_to_text(F.col("html")).cast("binary")).alias("text_md5"))


@query(f"SELECT page_id, {_html_text_sql('html')} AS text FROM {_ARTICLE}")
def main_article(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.main_article(F.col("html")).alias("text"))


@query("SELECT source, length(text) AS n_chars, md5(text) AS text_md5 FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, text DESC) AS nth FROM documents) WHERE nth = 1")
def longest_text_per_source(spark, sf_dir):
    found = grounding.longest_text(table(spark, sf_dir, "documents").select("source", "text"), "source")
    return found.select("source", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT count(*) AS n, count(DISTINCT text) AS texts FROM documents")
def dedupe_texts(spark, sf_dir):
    # Digests are shuffled, not texts.
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.unhex(F.sha2("text", 256))).alias("texts"))


@query("SELECT CAST(user_id AS VARCHAR) AS url, min(strftime(ts, '%Y')) AS year FROM events WHERE event_type <> 'view' GROUP BY user_id")
def min_year_per_user(spark, sf_dir):
    one = F.array(F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").filter("event_type <> 'view'").select(one.alias("urls_orig"), F.array().cast("array<string>").alias("urls_edit"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"))
    return grounding.urls_to_fetch(rows)


@query("""
WITH j AS (SELECT a.event_id AS row_id, b.event_id AS nearest_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), b.event_id DESC) AS nth
           FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'click')
SELECT row_id, nearest_id FROM j WHERE nth = 1
""")
def nearest_snapshot(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("row_id"), "user_id", F.col("ts").alias("at"))
    right = events.filter("event_type = 'click'").select(F.col("event_id").alias("nearest_id"), "user_id", "ts")
    return grounding.nearest(left, right, ["user_id"], "at", "ts", "nearest_id").select("row_id", "nearest_id")


@query("""
WITH j AS (SELECT a.event_id AS row_id, b.event_id AS nearest_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), b.event_id DESC) AS nth
           FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'view')
SELECT row_id, nth, nearest_id FROM j WHERE nth <= 3
""")
def nearest_k(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("row_id"), "user_id", F.col("ts").alias("at"))
    right = events.filter("event_type = 'view'").select(F.col("event_id").alias("nearest_id"), "user_id", "ts")
    return grounding.nearest(left, right, ["user_id"], "at", "ts", "nearest_id", k=3).select("row_id", F.col("nth").cast("long").alias("nth"), "nearest_id")


@query("SELECT doc_id, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def index_semi_join(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return grounding.filter_index(table(spark, sf_dir, "labels"), wanted, "doc_id").select("doc_id", "toxic")


@query("SELECT CAST(doc_id AS VARCHAR) AS url, '2024' AS year FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def urls_left_anti(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.array(F.col("doc_id").cast("string")).alias("urls_orig"), F.array().cast("array<string>").alias("urls_edit"), F.lit("2024-01-01").alias("timestamp"))
    have = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("url"))
    return grounding.urls_to_fetch(rows, have=have)


@query("SELECT doc_id, coalesce(l.quality, -1) AS quality FROM (SELECT doc_id FROM documents) d LEFT JOIN labels l USING (doc_id)")
def right_biased_merge(spark, sf_dir):
    default = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return grounding.right_biased_merge(default, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query(rf"SELECT page_id, seq, array_to_string(list_filter(regexp_extract_all(tgt_text, '[\p{{L}}\p{{N}}_]+'), lambda w: NOT list_contains(regexp_extract_all(src_text, '[\p{{L}}\p{{N}}_]+'), w)), ' ') AS added FROM {PAIRS}")
def list_difference_keep_dups(spark, sf_dir):
    return _pairs(spark, sf_dir).select("page_id", "seq", F.array_join(arrays.without(text.words(F.col("tgt_text")), text.words(F.col("src_text"))), " ").alias("added"))


@query("SELECT user_id, min(d) AS first, max(d) AS last, count(*) AS n FROM (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS run FROM (SELECT DISTINCT user_id, dayofyear(ts) AS d FROM events)) GROUP BY user_id, run")
def gaps_and_islands(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.dayofyear("ts").cast("long").alias("d"))
    return edits.islands(days, ["user_id"], "d")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS recent FROM events")
def sliding_window_sum(spark, sf_dir):
    rows = chain(table(spark, sf_dir, "events"), [edits.window_sum("value", ["user_id"], ["ts", "event_id"], 5, "recent")])
    return rows.select("event_id", F.round("recent", 6).alias("recent"))


_REF = "('the'), ('and'), ('is'), ('of'), ('er')"
_SNIPPET = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS toks FROM documents),
r AS (SELECT * FROM (VALUES {_REF}) v(w)),
x AS (SELECT doc_id, pos, toks[pos] AS tok, len(toks) AS n FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM t)),
f AS (SELECT x.doc_id, x.pos, x.n, CASE WHEN r.w IS NULL THEN 0 ELSE 1 END AS hit, x.tok FROM x LEFT JOIN r ON x.tok = r.w),
s AS (SELECT *, sum(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c FROM f),
c AS (SELECT doc_id, pos - 1 AS e, c, max(c) OVER (PARTITION BY doc_id) AS top FROM s WHERE n > 20 AND pos - 1 >= 20),
b AS (SELECT doc_id, e, c, row_number() OVER (PARTITION BY doc_id ORDER BY e) AS nth, count(*) OVER (PARTITION BY doc_id) AS k FROM c WHERE c = top)
SELECT doc_id, CAST(e - 20 AS BIGINT) AS start, CAST(c AS BIGINT) AS overlap FROM b WHERE nth = k // 2 + 1
UNION ALL SELECT doc_id, CAST(0 AS BIGINT), count(DISTINCT CASE WHEN hit = 1 THEN tok END) FROM f WHERE n <= 20 GROUP BY doc_id
UNION ALL SELECT doc_id, CAST(0 AS BIGINT), CASE WHEN toks IS NOT NULL THEN CAST(0 AS BIGINT) END FROM t WHERE coalesce(len(toks), 0) = 0
"""


@query(_SNIPPET)
def best_snippet_window(spark, sf_dir):
    return _snippet_windows(table(spark, sf_dir, "documents"))


def _snippet_windows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", text.words(F.lower("text")).alias("toks"))
    reference = F.array(*[F.lit(w) for w in ("the", "and", "is", "of", "er")])
    found = rows.withColumn("best", arrays.best_window(F.col("toks"), reference, 20))
    return found.select("doc_id", F.col("best.start").cast("long").alias("start"), F.col("best.overlap").cast("long").alias("overlap"))


@query(r"SELECT doc_id, pos - 1 AS line, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT doc_id, pos, len(regexp_extract_all(lines[pos], '[\p{L}\p{N}_]+')) AS n FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))")
def token_prefix_offsets(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), text.words)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(arrays.offsets(lines), F.lit(1), F.size(lines))).alias("line", "start"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("start"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS toks FROM documents),
x AS (SELECT doc_id, pos - 1 AS pos, toks[pos] AS tok FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM t)),
u AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS url_index FROM x WHERE tok = 'the'),
e AS (SELECT doc_id, pos AS at FROM x WHERE tok = 'of')
SELECT u.doc_id, CAST(u.url_index AS BIGINT) AS url_index, CAST(coalesce(min(abs(e.at - u.pos)), 100000000) AS BIGINT) AS dist FROM u LEFT JOIN e ON u.doc_id = e.doc_id GROUP BY u.doc_id, u.url_index
""")
def url_token_distance(spark, sf_dir):
    return _url_distances(table(spark, sf_dir, "documents"))


def _url_distances(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", text.words(F.lower("text")).alias("toks"))
    found = rows.select("doc_id", F.explode(arrays.distances(arrays.positions(F.col("toks"), "the"), arrays.positions(F.col("toks"), "of"))).alias("d"))
    return found.select("doc_id", F.col("d.url_index").cast("long").alias("url_index"), F.col("d.dist").cast("long").alias("dist"))


_TITLED = r"'^/\*([^\n]+)\*/([^\n]*)\n?\z'"


@query(rf"""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '/* ' || role || ' */ ' || text ELSE text END AS c FROM conversations),
m AS (SELECT *, regexp_matches(c, {_TITLED}) AS titled FROM c)
SELECT conv_id, turn, CASE WHEN titled THEN trim(regexp_extract(c, {_TITLED}, 1)) ELSE '' END AS title,
       md5(CASE WHEN titled THEN trim(replace(replace(replace(replace(replace(replace(trim(regexp_extract(c, {_TITLED}, 2)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')) ELSE c END) AS rest FROM m
""")
def section_title(spark, sf_dir):
    return _section_titles(table(spark, sf_dir, "conversations"))


def _section_titles(rows: DataFrame) -> DataFrame:
    comment = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("/* "), "role", F.lit(" */ "), "text")).otherwise(F.col("text"))
    found = rows.withColumn("t", text.section_title(comment))
    return found.select("conv_id", "turn", F.col("t.title").alias("title"), F.md5(F.col("t.rest").cast("binary")).alias("rest"))


@query("SELECT doc_id, n_chars FROM documents WHERE NOT contains(text, '|') AND length(text) >= 50 AND ends_with(text, '.')")
def target_quality_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(filters.target_quality("text")).select("doc_id", "n_chars")


@query("""
WITH p AS (SELECT a.doc_id, a.text AS source, b.text AS new_source FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id AS context, md5(source) AS grounding_true, md5(new_source) AS grounding_false, 't' AS target FROM p
UNION ALL SELECT doc_id, md5(new_source), md5(source), 'n' FROM p
""")
def counterfactual_explode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _with_next(docs, docs)


def _with_next(some: DataFrame, docs: DataFrame) -> DataFrame:
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("new_source"))
    rows = some.select("doc_id", F.md5(F.col("text").cast("binary")).alias("source")).join(nxt, "doc_id")
    return grounding.counterfactuals(rows.select("source", "new_source", F.col("doc_id").alias("context"), F.lit("t").alias("target"), F.lit("n").alias("new_target")))


@query(f"""
WITH s AS (SELECT ln(1 + l_quantity) AS score_true, ln(1 + l_extendedprice / 100) AS score_false FROM lineitem)
SELECT m.margin, (SELECT count(*) FROM s) AS n, round((SELECT avg(CASE WHEN score_false - score_true > m.margin THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM s), 9) AS accuracy
FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE), ({math.log(100)!r}::DOUBLE)) m(margin)
""")
def margin_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.log(1 + F.col("l_quantity")).alias("score_true"), F.log(1 + F.col("l_extendedprice") / 100).alias("score_false"))
    return scoring.margin_accuracy(rows, [0.0, 1.0, math.log(100)]).withColumn("accuracy", F.round("accuracy", 9))


@query(r"""
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS target, list_distinct(regexp_extract_all(lower(source || ' the of and'), '[\p{L}\p{N}_]+')) AS grounding FROM documents),
f AS (SELECT word, count(*) AS n FROM (SELECT unnest(target) AS word FROM d) GROUP BY word),
w AS (SELECT doc_id, unnest(CASE WHEN len(list_filter(target, lambda x: list_contains(grounding, x))) > 0 THEN list_filter(target, lambda x: list_contains(grounding, x)) ELSE target END) AS word FROM d),
k AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(f.n, 1000000), word) AS nth FROM w LEFT JOIN f USING (word))
SELECT d.doc_id, coalesce(k.word, 'n/a') AS control FROM d LEFT JOIN k ON k.doc_id = d.doc_id AND k.nth = 1
""")
def rarest_shared_token(spark, sf_dir):
    return _rarest_shared(table(spark, sf_dir, "documents"))


def _rarest_shared(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.array_distinct(text.words(F.lower("text"))).alias("target"), F.array_distinct(text.words(F.lower(F.concat("source", F.lit(" the of and"))))).alias("grounding"))
    frequency = rows.select(F.explode("target").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    # A split of texts makes some millions of words, so the join's partitions grow with the splits.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * docs.rdd.getNumPartitions())
    return grounding.control_tokens(rows, frequency, "doc_id", parts=parts)


_STOP = ", ".join(f"'{w}'" for w in sorted(set(text.STOP_WORDS["en"])))


@query(rf"SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({_STOP})))) AS word FROM documents WHERE lang = 'en'")
def stop_token_difference(spark, sf_dir):
    return _without_stop_words(table(spark, sf_dir, "documents").filter(F.col("lang") == "en"))


def _without_stop_words(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode(grounding.reference_tokens(text.words(F.lower("text")), F.lit(""))).alias("word"))


_DRAW = "CAST(('0x' || substr(md5({}), 1, 7)) AS BIGINT) / 268435456.0::DOUBLE"


@query(f"SELECT doc_id, source FROM documents WHERE {_DRAW.format('CAST(doc_id AS VARCHAR)')} < 0.1::DOUBLE")
def hash_sample(spark, sf_dir):
    return chain(table(spark, sf_dir, "documents"), [sampling.hash_sample(0.1, "doc_id")]).select("doc_id", "source")


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format('CAST(doc_id AS VARCHAR)')}, doc_id) AS nth FROM documents) WHERE nth <= 3")
def k_per_source(spark, sf_dir):
    return chain(table(spark, sf_dir, "documents"), [sampling.k_of_group(3, ["source"], "doc_id")]).select("source", "doc_id")


@query("SELECT conv_id, turn, coalesce(md5(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS earlier, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM conversations")
def negatives_running_list(spark, sf_dir):
    rows = chain(table(spark, sf_dir, "conversations"), [edits.negatives_before("conv_id", ["turn"], "text")])
    return rows.select("conv_id", "turn", F.when(F.size("negatives") > 0, F.md5(F.array_join("negatives", "|").cast("binary"))).otherwise("").alias("earlier"), F.size("negatives").cast("long").alias("n"))


_MARKUP = r"'[[a|' || role || ']] ''''bold'''' {{cite|x}} <b>gone</b><br/> &nbsp;<!-- note -->' || text"


@query(rf"""
SELECT conv_id, turn, md5(trim(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(
  regexp_replace(t, '\[\[[^\[\]]+\|([^\[\]]+)\]\]', '\1', 'g'), '[[', ''), ']]', ''), '''''', ''), '(?s)<table.*>.*</table>', '', 'g'), '<!--[^<>]*-->', '', 'g'), '<\w+>[^<>]*</\w+>', '', 'g'), '<\w+>|<\w+/>', '', 'g'), '\{{\{{[^{{}}]*\}}\}}', '', 'g'), '&nbsp;', ''), chr(10))) AS cleaned
FROM (SELECT conv_id, turn, {_MARKUP} AS t FROM conversations)
""")
def markup_clean_chain(spark, sf_dir):
    marked = F.concat(F.lit("[[a|"), "role", F.lit("]] ''bold'' {{cite|x}} <b>gone</b><br/> &nbsp;<!-- note -->"), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.clean_wikitext(marked).cast("binary")).alias("cleaned"))


@query("SELECT conv_id, turn, 'https://en.wikipedia.org/w/index.php?title=' || replace(role || ' page', ' ', '%20') || '&type=revision&diff=' || CAST(turn AS VARCHAR) || '&oldid=' || CAST(turn - 1 AS VARCHAR) AS diff_url FROM conversations")
def diff_url(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.diff_url(F.concat("role", F.lit(" page")), F.col("turn").cast("string"), (F.col("turn") - 1).cast("string")).alias("diff_url"))


@query(r"""
SELECT step, CAST(pos AS BIGINT) AS pos, rows_in, rows_out FROM (
  SELECT 'long' AS step, 1 AS pos, count(*) AS rows_in, count(*) FILTER (WHERE length(text) >= 100) AS rows_out FROM documents
  UNION ALL SELECT 'english', 2, count(*) FILTER (WHERE length(text) >= 100), count(*) FILTER (WHERE length(text) >= 100 AND lang = 'en') FROM documents
  UNION ALL SELECT 'sentence', 3, count(*) FILTER (WHERE length(text) >= 100 AND lang = 'en'), count(*) FILTER (WHERE length(text) >= 100 AND lang = 'en' AND ends_with(text, '.')) FROM documents)
""")
def funnel(spark, sf_dir):
    steps = [("long", F.length("text") >= 100), ("english", F.col("lang") == "en"), ("sentence", F.endswith("text", F.lit(".")))]
    return funnel_counts(table(spark, sf_dir, "documents"), steps).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT count(*) AS wanted, count(l.doc_id) AS done, count(*) FILTER (WHERE l.toxic = 1) AS not_empty, round(count(l.doc_id) / count(*), 9) AS done_share, round(count(*) FILTER (WHERE l.toxic = 1) / count(l.doc_id), 9) AS not_empty_share FROM documents d LEFT JOIN labels l USING (doc_id)")
def fetch_progress(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"))
    got = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("url"), F.array_repeat(F.lit("x"), F.col("toxic").cast("int")).alias("results"))
    made = grounding.progress(wanted, got)
    return made.withColumns({c: F.round(c, 9) for c in ("done_share", "not_empty_share")})


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN f.doc_id IS NULL THEN 'miss' WHEN md5(f.text) = d.want THEN 'pass' ELSE 'crash' END AS status FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5('other') ELSE md5(text) END AS want FROM documents) d LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0) f USING (doc_id)) GROUP BY status")
def md5_manifest(spark, sf_dir):
    from palimpsest.sources.dumps import verify_md5

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").cast("binary").alias("content"))
    manifest = docs.select("file", F.when(F.col("file") % 7 == 0, F.md5(F.lit("other").cast("binary"))).otherwise(F.md5("content")).alias("md5"))
    return verify_md5(manifest, docs.filter(F.col("file") % 5 != 0)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS url, strftime(o_orderdate, '%Y') AS year, i.index FROM orders, (VALUES ('1993-05'), ('1995-18'), ('1997-49')) i(index) WHERE CAST(split_part(i.index, '-', 1) AS INTEGER) <= year(o_orderdate)")
def index_years(spark, sf_dir):
    urls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("url"), F.date_format("o_orderdate", "yyyy").alias("year"))
    return grounding.index_years(urls, ["1993-05", "1995-18", "1997-49"])


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS toks FROM conversations),
x AS (SELECT conv_id, turn, pos - 1 AS pos, toks[pos] AS tok FROM (SELECT conv_id, turn, toks, unnest(range(1, len(toks) + 1)) AS pos FROM t)),
w AS (SELECT conv_id, turn, pos, tok, CASE WHEN tok IN ('the', 'of') THEN 1 ELSE 0 END AS action, max(CASE WHEN tok IN ('the', 'of') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM x)
SELECT conv_id, turn, string_agg(tok, ' ' ORDER BY pos) AS tokens, string_agg(CAST(action AS VARCHAR), '' ORDER BY pos) AS actions FROM w WHERE near = 1 GROUP BY conv_id, turn
""")
def token_context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("toks"))
    edited = F.array_sort(F.concat(arrays.positions(F.col("toks"), "the"), arrays.positions(F.col("toks"), "of")))
    found = rows.withColumn("c", arrays.token_context(F.col("toks"), edited, 2)).filter(F.size("c.tokens") > 0)
    return found.select("conv_id", "turn", F.array_join("c.tokens", " ").alias("tokens"), F.array_join(F.transform("c.action", lambda a: a.cast("string")), "").alias("actions"))


@query("SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\x0b\\x0c]+'), lambda w: w <> '')) >= 8 AND NOT contains(text, 'Undid revision') AS BOOLEAN) AS accepted, (turn % 4 = 0 OR turn % 4 > 2 OR NOT starts_with(trim(text), '/*') OR ends_with(trim(text), '*/') OR regexp_matches(text, '(?i)(revert|undo|undid)')) AS rejected FROM conversations")
def comment_checks(spark, sf_dir):
    return _comment_checks(table(spark, sf_dir, "conversations"))


def _comment_checks(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", filters.comment_accepted(8, "text").alias("accepted"), filters.comment_rejected(F.col("text"), F.col("turn") % 4, 2).alias("rejected"))


@query("SELECT doc_id, substr(text, 1, 600) AS preview, length(text) AS n FROM documents")
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 600).alias("preview"), F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, concat_ws(chr(9), CAST(doc_id AS VARCHAR), coalesce(lang, ''), coalesce(source, ''), CAST(n_chars AS VARCHAR)) AS line FROM documents")
def tsv_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sinks.tsv_line(["doc_id", "lang", "source", "n_chars"]).alias("line"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5('<doc id=\"' || doc_id || '\" url=\"http://w?curid=' || doc_id || '\" title=\"' || source || '\">' || chr(10) || source || chr(10) || chr(10) || text || chr(10) || '</doc>' || chr(10)) AS doc FROM documents")
def document_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text")
    return rows.select("id", F.md5(sinks.document_line("http://w").cast("binary")).alias("doc"))


@query("SELECT CAST(url AS VARCHAR) AS url, count(*) AS n FROM (SELECT l_partkey AS url FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY url")
def url_explode(spark, sf_dir):
    return _url_counts(table(spark, sf_dir, "lineitem"))


def _url_counts(items: DataFrame) -> DataFrame:
    rows = items.select(F.explode(F.concat(F.array("l_partkey"), F.array("l_suppkey")).cast("array<string>")).alias("url"))
    return rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT slice, count(*) AS n FROM (SELECT CAST(CAST(doc_id AS BIGINT) % 64 AS INTEGER) AS slice FROM documents) GROUP BY slice")
def work_slices(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.pmod("doc_id", F.lit(64)).cast("int").alias("slice")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS file, CAST(nth AS INTEGER) AS idx FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS nth FROM part) WHERE nth BETWEEN 11 AND 30")
def file_slice(spark, sf_dir):
    from palimpsest.sources.dumps import numbered

    return numbered(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file")), "file", 11, 30)


@query("SELECT name, CAST(regexp_extract(name, 'xml-p(\\d+)p(\\d+)\\.', 2) AS BIGINT) - CAST(regexp_extract(name, 'xml-p(\\d+)p(\\d+)\\.', 1) AS BIGINT) AS articles FROM (SELECT 'dump.xml-p' || p_partkey || 'p' || (p_partkey * 3) || '.bz2' AS name FROM part)")
def article_estimate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("dump.xml-p"), "p_partkey", F.lit("p"), F.col("p_partkey") * 3, F.lit(".bz2")).alias("name"))
    return rows.select("name", text.file_article_estimate(F.col("name")).alias("articles"))


_TRIM_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 20 AS g, CAST(l_suppkey % 700 AS BIGINT) AS c, CAST(l_partkey % 150 AS BIGINT) AS t FROM lineitem),
o AS (SELECT *, greatest(g + c + t - 1024, 0) AS over_ FROM s),
p AS (SELECT *, least(over_, abs(g - c)) AS by_gap FROM o),
q AS (SELECT *, over_ - by_gap AS rest FROM p)
SELECT l_orderkey, l_linenumber, greatest(g - (CASE WHEN g > c THEN by_gap ELSE 0 END + rest // 2), 0) AS kept_g, greatest(c - (CASE WHEN c >= g THEN by_gap ELSE 0 END + (rest + 1) // 2), 0) AS kept_c FROM q
"""


@query(_TRIM_SQL)
def trim_lengths(spark, sf_dir):
    return _kept_lengths(table(spark, sf_dir, "lineitem"))


def _kept_lengths(rows: DataFrame) -> DataFrame:
    fill = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    cut = arrays.trimmed(fill(F.col("l_quantity").cast("long") * 20), fill(F.col("l_suppkey") % 700), fill(F.col("l_partkey") % 150))
    return rows.withColumn("cut", cut).select("l_orderkey", "l_linenumber", F.size("cut.grounding").cast("long").alias("kept_g"), F.size("cut.context").cast("long").alias("kept_c"))


_UNIGRAM = r"""
WITH b AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS target FROM benchmark),
c AS (SELECT item_id, target, target[1:len(target) // 2] AS context FROM b),
k AS (SELECT item_id, target, context, len(list_distinct(list_concat(context, target))) AS kinds FROM c),
w AS (SELECT item_id, context, kinds, unnest(target) AS word FROM k)
SELECT item_id, round(sum(-ln((len(list_filter(context, lambda x: x = word)) + 0.1::DOUBLE) / (len(context) + 0.1::DOUBLE * kinds))), 6) AS nll FROM w GROUP BY item_id
"""


@query(_UNIGRAM)
def ngram_nll_score(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("target"))
    context = F.slice("target", F.lit(1), F.floor(F.size("target") / 2).cast("int"))
    return rows.select("item_id", F.round(scoring.nll(context, F.col("target")), 6).alias("nll"))


@query(rf"""
WITH p AS (SELECT page_id, seq, regexp_extract_all(src_text, '[\p{{L}}\p{{N}}_]+') AS s, regexp_extract_all(tgt_text, '[\p{{L}}\p{{N}}_]+') AS t FROM {PAIRS}),
a AS (SELECT page_id, seq, i, s[i] AS w FROM (SELECT page_id, seq, s, unnest(range(1, len(s) + 1)) AS i FROM p)),
b AS (SELECT page_id, seq, j, t[j] AS w FROM (SELECT page_id, seq, t, unnest(range(1, len(t) + 1)) AS j FROM p))
SELECT a.page_id, a.seq, count(*) AS near_matches FROM a JOIN b ON a.page_id = b.page_id AND a.seq = b.seq AND a.w = b.w AND b.j >= a.i - 5 AND b.j < a.i + 5 GROUP BY a.page_id, a.seq
""")
def band_join(spark, sf_dir):
    near = edits.near_equals(_pairs(spark, sf_dir), ["page_id", "seq"], text.words(F.col("src_text")), text.words(F.col("tgt_text")), 5)
    return near.groupBy("page_id", "seq").agg(F.count(F.lit(1)).alias("near_matches"))


@query()
def seq_diff_added_tokens(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumns({"src_tokens": text.tokens(F.col("src_text")), "tgt_tokens": text.tokens(F.col("tgt_text"))})
    found = chain(rows, [edits.token_diff, filters.has_diff, edits.edit_spans])
    return found.select("page_id", "seq", F.size("src_token_diff").alias("removed"), F.size("tgt_token_diff").alias("added"), F.size("tgt_token_diffs").alias("spans"))


@query(f"SELECT page_id, seq, src_text AS prefix, '' AS original, ' ' || tgt_text AS edited FROM {PAIRS} WHERE length(tgt_text) >= 20 AND len(list_filter(regexp_split_to_array(tgt_text, '[ \\t\\r\\n\\x0b\\x0c]+'), lambda w: w <> '')) > 3")
def insertion_triples(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    rows = rows.withColumn("tgt_text", F.concat("src_text", F.lit(" "), "tgt_text"))
    found = rows.withColumn("t", python.insertion_column(F.col("src_text"), F.col("tgt_text"), 20, 3)).filter("t IS NOT NULL")
    return found.select("page_id", "seq", "t.prefix", "t.original", "t.edited")


@query()
def bleu_alignment(spark, sf_dir):
    rows = chain(_pairs(spark, sf_dir), [edits.tokenize, edits.match_sentences(5, 2)])
    return rows.select("page_id", "seq", "i", F.col("source.sentence").alias("source"), F.col("target.sentence").alias("target"), F.round("match_score", 6).alias("match_score"))


@query()
def wikitext_extract(spark, sf_dir):
    from palimpsest.functions import wikitext

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("== "), "role", F.lit(" ==\n{{Intro|"), "role", F.lit("}} [[a|link]]s "), "text", F.lit("\n* ''item''")).alias("text"), "role")
    rows = rows.withColumn("title", F.col("role")).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    found = wikitext.extract(rows, ({"Template:Intro": "{{ucfirst:{{{1}}}}} says:"}, {}))
    return found.select("conv_id", "turn", F.array_join("lines", "\n").alias("text"))


def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits made of documents, each citing its page and the next one, joined with the pages' texts."""
    from palimpsest.plans.ablation import build_pairs

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    n = pages.count()
    docs, half = table(spark, sf_dir, "documents"), F.floor(F.length("text") / 2).cast("int")
    cited = lambda shift, name: pages.select(((F.col("page_id") + shift) % n).alias("own_page"), F.array("url").alias(name))
    # Pages are found by narrow rows, and the key is that of article_texts(): texts are shuffled once, as they are.
    own = F.col("doc_id").cast("string").alias("rev_id")
    urls = docs.select(own, (F.col("doc_id") % n).alias("own_page")).distinct().join(cited(0, "urls_edit"), "own_page").join(cited(1, "urls_orig"), "own_page")
    texts = docs.select(own, "text").join(urls, "rev_id")
    edits_ = texts.select("own_page", "rev_id", F.substring("text", F.lit(1), half).alias("prefix"), F.substring("text", half + 1, F.length("text")).alias("edited"), F.reverse(F.substring("text", half + 1, F.length("text"))).alias("original"), "urls_edit", "urls_orig")
    return build_pairs(edits_, pages)


_INVALID = " OR ".join([*[f"ends_with(url, '{x}')" for x in text.BARE_SUFFIXES], f"contains(url, '{text.VIDEO_SITE}')"])


@query(f"""
WITH t AS (SELECT url, arg_max(text, length(text)) AS text FROM (SELECT url, {_html_text_sql('html')} AS text FROM {_ARTICLE} WHERE NOT ({_INVALID})) WHERE text <> '' GROUP BY url),
p AS (SELECT page_id, url, (SELECT count(*) FROM pages) AS n FROM pages),
d AS (SELECT *, length(text) // 2 AS half FROM documents)
SELECT substr(d.text, 1, half) AS context, a.text AS grounding_0, substr(d.text, half + 1) AS target_0, b.text AS grounding_1, reverse(substr(d.text, half + 1)) AS target_1
FROM d JOIN p e ON e.page_id % e.n = d.doc_id % e.n JOIN p o ON (o.page_id + 1) % o.n = d.doc_id % o.n JOIN t a ON a.url = e.url JOIN t b ON b.url = o.url WHERE e.url <> o.url
""")
def ablation_pairs(spark, sf_dir):
    return _ablation(spark, sf_dir)


@query()
def ablation_end_to_end(spark, sf_dir):
    from palimpsest.plans.ablation import evaluate

    return evaluate(grounding.as_dataset(_ablation(spark, sf_dir)))


_LANGUAGES = sorted(text.STOP_WORDS)
_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in sorted(set(text.STOP_WORDS[k])))}))) AS {k}" for k in _LANGUAGES)
_FIRST = " ".join(f"WHEN {k} = greatest({', '.join(_LANGUAGES)}) THEN '{k}'" for k in _LANGUAGES)


@query(rf"SELECT doc_id, CASE WHEN greatest({', '.join(_LANGUAGES)}) = 0 THEN NULL {_FIRST} END AS lang FROM (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, regexp_extract_all(lower(substr(text, 1, 100000)), '[\p{{L}}\p{{N}}_]+') AS w FROM documents))")
def document_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("lang"))


@query("SELECT c.conv_id, c.turn, coalesce((SELECT max(p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.role = 'user'), -1) AS before, coalesce((SELECT min(p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn > c.turn AND p.role = 'user'), -1) AS after FROM conversations c")
def conserved_neighbours(spark, sf_dir):
    rows = edits.marked_neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")))
    return rows.select("conv_id", "turn", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: revision pairs of fitting length, counted by author."""
    return pair_length_filter(spark, sf_dir)
