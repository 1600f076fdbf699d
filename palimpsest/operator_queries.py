"""More queries, each holding a whole operator against SQL that finds its result another way.

Where the driver's tables have no revisions with known edits, those are made of columns: an order is a page of three sentences
whose middle one is edited in one of four ways, so that SQL can say what the operators have to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text, windows
from palimpsest.operators import edits, filters, grounding, scoring
from palimpsest.pipeline import chain, flat_map
from palimpsest.queries import ORACLE_SQL, QUERIES, query, table
from palimpsest.sources import dumps, sinks, stores

__all__ = ["ORACLE_SQL", "QUERIES"]

_WORDS_SQL = r"'[\p{L}\p{N}_]+'"
_SPACED_SQL = r"list_filter(regexp_split_to_array({}, '[ \t\r\n\x0b\x0c]+'), lambda w: w <> '')"


def _edited_orders(spark, sf_dir) -> DataFrame:
    """Orders as pairs of token lists: kind 0 adds three tokens, 1 adds in two places, 2 also replaces a token, 3 adds far from the URL."""
    o = table(spark, sf_dir, "orders").withColumn("kind", F.pmod("o_orderkey", F.lit(4)))
    s = lambda *xs: F.array(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    key, cust = F.col("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey"))
    first = s("order", key, ".")
    new = F.when(F.col("kind") == 3, s("far", "new", F.concat(key, F.lit("n")))).otherwise(s("URL", "new", F.concat(key, F.lit("n"))))
    status = F.when(F.col("kind") == 2, F.lit("swapped")).otherwise(F.col("o_orderstatus"))
    last = F.when(F.col("kind") == 3, s("URL", "end")).otherwise(s("the", "end"))
    tail = F.when(F.col("kind") == 1, F.when(key % 8 == 5, s("z")).otherwise(s("tail"))).otherwise(F.array().cast("array<string>"))
    src = F.array(first, F.concat(s(F.col("o_orderstatus")), s(F.col("o_orderpriority"), cust, ".")), F.concat(last, s(".")))
    tgt = F.array(first, F.concat(F.array(status), new, s(F.col("o_orderpriority"), cust, ".")), F.concat(last, tail, s(".")))
    rows = o.select("o_orderkey", "kind", src.alias("src_sents"), tgt.alias("tgt_sents"))
    none = F.array().cast("array<string>")
    return rows.withColumns({"src_tokens": F.flatten("src_sents"), "tgt_tokens": F.flatten("tgt_sents"), "src_urls": none, "tgt_urls": F.array(F.concat(F.lit("http://o/"), "o_orderkey"))})


@query("""
WITH o AS (SELECT *, o_orderkey % 4 AS kind, CAST(o_orderkey AS VARCHAR) AS k FROM orders)
SELECT o_orderkey, 'order ' || k || ' . ' || o_orderstatus AS left_text, 'URL new' AS tgt_text, k || 'n ' || o_orderpriority || ' c' || o_custkey || ' . the end .' AS right_text, 'http://o/' || k AS url
FROM o WHERE kind = 0
""")
def addition_chain(spark, sf_dir):
    """The steps from token diffs to contexts: only single additions next to their URL pass."""
    steps = [edits.token_diff, filters.has_diff, edits.edit_spans, filters.single_edit_span, filters.additions(3, 100), edits.url_distance(1), filters.not_empty("grounding_urls"), edits.sentence_context(1, 1), filters.min_context(3, 0)]
    rows = chain(_edited_orders(spark, sf_dir), steps)
    return rows.select("o_orderkey", "left_text", "tgt_text", "right_text", F.array_join("grounding_urls", " ").alias("url"))


@query("""
SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS removed, CAST(CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 3 THEN 3 ELSE 4 END AS INTEGER) AS added,
       CASE o_orderkey % 4 WHEN 0 THEN '4,5,6' WHEN 3 THEN '4,5,6' WHEN 1 THEN '4,5,6|12' ELSE '3,4,5,6' END AS spans FROM orders
""")
def edit_kinds(spark, sf_dir):
    found = chain(_edited_orders(spark, sf_dir), [edits.token_diff, edits.edit_spans])
    shown = F.array_join(F.transform("tgt_token_diffs", lambda s: F.array_join(s.cast("array<string>"), ",")), "|")
    return found.select("o_orderkey", F.size("src_token_diff").alias("removed"), F.size("tgt_token_diff").alias("added"), shown.alias("spans"))


@query("""
SELECT o_orderkey, CAST(unnest(CASE o_orderkey % 4 WHEN 1 THEN [4, 12] WHEN 2 THEN [3] ELSE [4] END) AS INTEGER) AS first FROM orders
""")
def split_edit_spans(spark, sf_dir):
    found = chain(_edited_orders(spark, sf_dir), [edits.token_diff, edits.edit_spans, edits.split_spans])
    return found.filter(F.size("src_token_diff") == 0).select("o_orderkey", F.get("tgt_token_diff", 0).alias("first"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 8 <> 5 THEN '1,2' ELSE '1' END AS changed FROM orders WHERE NOT (o_orderkey % 4 = 1 AND o_orderkey % 8 <> 5)
""")
def sentence_changes(spark, sf_dir):
    """Sentences with edited tokens, those of one character aside; of three, two or more are unchanged."""
    found = chain(_edited_orders(spark, sf_dir), [edits.token_diff, edits.changed_sentences(), filters.enough_unchanged(2)])
    return found.select("o_orderkey", F.array_join(F.col("tgt_sent_diff").cast("array<string>"), ",").alias("changed"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN k2 || ' the end ' || CASE WHEN o_orderkey % 8 = 5 THEN 'z' ELSE 'tail' END || ' .' ELSE k2 || CASE WHEN o_orderkey % 4 = 3 THEN ' URL end .' ELSE ' the end .' END END AS tokens
FROM (SELECT *, CASE WHEN o_orderkey % 4 = 2 THEN 'swapped' ELSE o_orderstatus END || CASE WHEN o_orderkey % 4 = 3 THEN ' far' ELSE ' URL' END || ' new ' || o_orderkey || 'n ' || o_orderpriority || ' c' || o_custkey || ' .' AS k2 FROM orders) WHERE o_orderkey % 4 = 1
UNION ALL
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 'swapped' ELSE o_orderstatus END || CASE WHEN o_orderkey % 4 = 3 THEN ' far' ELSE ' URL' END || ' new ' || o_orderkey || 'n ' || o_orderpriority || ' c' || o_custkey || ' .' FROM orders WHERE o_orderkey % 4 <> 1
""")
def sentences_pruned(spark, sf_dir):
    """The target's tokens after pruning both sides to the sentences that changed."""
    return chain(_edited_orders(spark, sf_dir), [edits.prune_to_changed_sentences]).select("o_orderkey", F.array_join("tgt_tokens", " ").alias("tokens"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'deletion' ELSE 'insertion' END AS type FROM lineitem WHERE l_partkey % 3 < 2 AND l_suppkey % 4 <> 0
""")
def contiguous_edits(spark, sf_dir):
    base = F.col("l_linenumber").cast("int")
    run = F.when(F.col("l_suppkey") % 4 == 0, F.array(base, base + 2)).when(F.col("l_suppkey") % 4 == 1, F.array(base)).otherwise(F.array(base, base + 1, base + 2))
    side = lambda k: F.when((F.col("l_partkey") % 3 == k) | (F.col("l_partkey") % 3 == 2), run).otherwise(F.array().cast("array<int>"))
    rows = table(spark, sf_dir, "lineitem").withColumns({"src_diff": side(0), "tgt_diff": side(1)})
    return filters.contiguous_edit()(rows).select("l_orderkey", "l_linenumber", "l_partkey", "type")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 5 <> 0 AND NOT regexp_matches(text, '(?m)^(?:The )') AND lang <> 'de' AND (source < 'src3' OR lang = 'en')")
def kept_pages(spark, sf_dir):
    """Namespace, redirects, disambiguation and categories; page_id and has_comment by the way."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 1, "1").otherwise("0").alias("ns"), F.when(F.col("doc_id") % 5 == 0, "other").alias("redirect"), F.array("lang", F.when(F.col("source") < "src3", "early").otherwise("late")).alias("categories"))
    return filters.keep_page("The ", include=["early", "en"], exclude=["de"])(rows).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE (doc_id % 2 = 1 OR doc_id % 3 = 1) AND NOT (doc_id % 2 = 1 AND doc_id % 3 = 1) AND len({_SPACED_SQL.format('text')}) < 100 AND len({_SPACED_SQL.format('source')}) < 100")
def valid_pairs(spark, sf_dir):
    url = lambda m: F.when(F.col("doc_id") % m == 1, F.array(F.lit("http://a"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("target_edit"), F.col("source").alias("target_orig"), url(2).alias("urls_edit"), url(3).alias("urls_orig"))
    return filters.valid_pair(rows).select("doc_id")


@query("SELECT doc_id, doc_id % 2 = 1 AND doc_id % 3 = 1 AS both FROM documents WHERE doc_id % 2 = 1 OR doc_id % 3 = 1")
def url_side_filters(spark, sf_dir):
    url = lambda m: F.when(F.col("doc_id") % m == 1, F.array(F.lit("http://a"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", url(2).alias("urls_edit"), url(3).alias("urls_orig"))
    both = filters.url_sides(True)(rows).select("doc_id", F.lit(True).alias("both"))
    return filters.url_sides(False)(rows).join(both, "doc_id", "left").select("doc_id", F.coalesce("both", F.lit(False)).alias("both"))


@query(f"SELECT doc_id FROM documents WHERE NOT list_has_any(regexp_extract_all(lower(text), {_WORDS_SQL}), ['river', 'er', 'license', 'an'])")
def word_filter(spark, sf_dir):
    return filters.no_words(["River", "er", "license", "an"], ["text"])(table(spark, sf_dir, "documents")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[\[\]|/\\$#@%]')")
def punctuation_filter(spark, sf_dir):
    return filters.no_punctuation(["text"])(table(spark, sf_dir, "documents")).select("doc_id")


@query("SELECT page_id FROM pages WHERE page_id IN (1, 2, 3, 5, 8, 13, 144, 233) OR page_id IN (SELECT item_id FROM benchmark)")
def pages_by_id(spark, sf_dir):
    """A list of ids as a literal, and a table of ids as a semi-join."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    listed = filters.page_ids([1, 2, 3, 5, 8, 13, 144, 233])(pages)
    return listed.unionByName(dumps.with_ids(pages, table(spark, sf_dir, "benchmark").select("item_id"), "page_id")).distinct()


@query(r"""
WITH p AS (SELECT page_id, url, html || ' http://x.org/' || page_id || ' ' || url AS tgt, html AS src FROM pages)
SELECT page_id, len(regexp_extract_all(src, 'https?://[^\s|\]]+')) AS n_src, len(regexp_extract_all(tgt, 'https?://[^\s|\]]+')) AS n_tgt, len(list_distinct(list_concat(regexp_extract_all(src, 'https?://[^\s|\]]+'), regexp_extract_all(tgt, 'https?://[^\s|\]]+')))) AS n_all, md5(regexp_replace(tgt, 'https?://[^\s|\]]+', 'URL', 'g')) AS cleaned FROM p
""")
def cited_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("src_text"), F.concat_ws(" ", "html", F.concat(F.lit("http://x.org/"), "page_id"), "url").alias("tgt_text"))
    found = chain(rows, [edits.clean_urls(), filters.has_urls()])
    return found.select("page_id", *[F.size(c).cast("long").alias(n) for c, n in (("src_urls", "n_src"), ("tgt_urls", "n_tgt"), ("grounding_urls", "n_all"))], F.md5(F.col("tgt_text").cast("binary")).alias("cleaned"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[ \t]+', ' ', 'g')) AS spaced, nullif(array_to_string(list_filter([source, lang], lambda x: x <> 'de'), ' ;; '), '') AS joined FROM documents")
def spaces_and_snippets(spark, sf_dir):
    joined = grounding.join_snippets(F.filter(F.array("source", "lang"), lambda x: x != "de"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.compress_spaces(F.col("text")).cast("binary")).alias("spaced"), joined.alias("joined"))


_SECTIONED = "concat(role, ' lead', chr(10), '== A ==', chr(10), md5(text), chr(10), '=== B ===', chr(10), text, chr(10), '== A ==', chr(10), 'again ', role)"


def _sectioned(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("page", F.concat("role", F.lit(" lead\n== A ==\n"), F.md5(F.col("text").cast("binary")), F.lit("\n=== B ===\n"), "text", F.lit("\n== A ==\nagain "), "role"))


@query(r"""
SELECT conv_id, turn, unnest(['Lead', 'A', 'B', 'A']) AS title, unnest([md5(role || ' lead'), md5(md5(text)), md5(trim(text, chr(10) || ' ')), md5('again ' || role)]) AS text_md5 FROM conversations
""")
def page_sections(spark, sf_dir):
    rows = _sectioned(spark, sf_dir).select("conv_id", "turn", F.explode(text.sections(F.col("page"))).alias("s"))
    return rows.select("conv_id", "turn", F.col("s.title").alias("title"), F.md5(F.col("s.text").cast("binary")).alias("text_md5"))


@query("""
SELECT conv_id, turn, 'Lead' AS section_title, role || ' lead' AS src, role || ' lead' AS tgt FROM conversations
UNION ALL SELECT conv_id, turn, 'A', md5(text), 'again ' || role FROM conversations
UNION ALL SELECT conv_id, turn, 'A', 'again ' || role, 'again ' || role FROM conversations
UNION ALL SELECT conv_id, turn, 'B', md5(trim(text, chr(10) || ' ')), md5(trim(text, chr(10) || ' ')) FROM conversations
""")
def section_pairs(spark, sf_dir):
    """Every source section with the last target section of its title."""
    rows = edits.split_sections(_sectioned(spark, sf_dir).select("conv_id", "turn", F.col("page").alias("src_text"), F.col("page").alias("tgt_text")))
    shown = lambda c: F.when(F.col("section_title") == "B", F.md5(F.col(c).cast("binary"))).otherwise(F.col(c))
    return rows.select("conv_id", "turn", "section_title", shown("src_text").alias("src"), shown("tgt_text").alias("tgt"))


@query("SELECT conv_id, turn, md5(trim(text, chr(10) || ' ')) AS section FROM conversations WHERE turn % 2 = 0 AND trim(text, chr(10) || ' ') <> ''")
def restricted_sections(spark, sf_dir):
    """Texts cut down to the section of the comment; rows whose comment names none, or one that isn't there, go."""
    title = F.when(F.col("turn") % 2 == 0, "B").when(F.col("turn") % 4 == 1, "").otherwise("C")
    rows = _sectioned(spark, sf_dir).withColumns({"section_title": title, "src_text": F.col("page"), "tgt_text": F.col("page")})
    found = chain(rows, [filters.has_section_title(), edits.restrict_to_section])
    return found.select("conv_id", "turn", F.md5(F.col("tgt_text").cast("binary")).alias("section"))


@query("""SELECT doc_id, '<ref name="a">' || source || '</ref> <ref name="b"/> {{sfn|x|' || doc_id || '}}' AS refs, md5(text || ' ' || text) AS kept FROM documents""")
def references_out(spark, sf_dir):
    """References leave the text, in order."""
    docs = table(spark, sf_dir, "documents")
    marked = F.concat("text", F.lit('<ref name="a">'), "source", F.lit("</ref> "), F.lit('<ref name="b"/>'), "text", F.lit("{{sfn|x|"), "doc_id", F.lit("}}"))
    found = edits.process_references(docs.withColumns({"src_text": marked, "tgt_text": marked}))
    return found.select("doc_id", F.array_join("refs", " ").alias("refs"), F.md5(F.col("tgt_text").cast("binary")).alias("kept"))


_CITING = """
o AS (SELECT o_orderkey AS k, [CAST(o_custkey % 50 AS VARCHAR), CAST(o_orderkey % 70 AS VARCHAR), CAST(o_custkey % 7 AS VARCHAR)] AS e, [CAST(o_custkey % 7 AS VARCHAR), CAST(o_orderkey % 11 AS VARCHAR)] AS g FROM orders),
t AS (SELECT CAST(p_partkey AS VARCHAR) AS url, p_name AS text FROM part WHERE p_partkey % 3 <> 0),
x AS (SELECT k, 'edit' AS side, unnest(list_filter(e, lambda u: NOT list_contains(g, u))) AS url, generate_subscripts(list_filter(e, lambda u: NOT list_contains(g, u)), 1) AS pos FROM o
      UNION ALL SELECT k, 'orig', unnest(g), generate_subscripts(g, 1) FROM o),
j AS (SELECT k, side, list(text ORDER BY pos) AS texts FROM x JOIN t USING (url) GROUP BY k, side)
"""


def _citing(spark, sf_dir) -> DataFrame:
    s = lambda c, m: F.pmod(c, F.lit(m)).cast("string")
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("k"), F.array(s("o_custkey", 50), s("o_orderkey", 70), s("o_custkey", 7)).alias("urls_edit"), F.array(s("o_custkey", 7), s("o_orderkey", 11)).alias("urls_orig"), F.concat(F.lit("p"), "o_orderkey").alias("prefix"), F.col("o_orderstatus").alias("edited"), F.col("o_orderpriority").alias("original"))
    texts = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("url"), F.col("p_name").alias("text"))
    return grounding.article_texts(rows, texts, "k")


@query(f"WITH {_CITING} SELECT o.k, coalesce(array_to_string(a.texts, '|'), '') AS text_edit, coalesce(array_to_string(b.texts, '|'), '') AS text_orig FROM o LEFT JOIN j a ON a.k = o.k AND a.side = 'edit' LEFT JOIN j b ON b.k = o.k AND b.side = 'orig'")
def article_texts(spark, sf_dir):
    return _citing(spark, sf_dir).select("k", F.array_join("text_edit", "|").alias("text_edit"), F.array_join("text_orig", "|").alias("text_orig"))


@query(f"WITH {_CITING} SELECT 'p' || o.k AS context, a.texts[1] AS grounding_true, b.texts[1] AS grounding_false, r.o_orderstatus AS target FROM o JOIN orders r ON r.o_orderkey = o.k JOIN j a ON a.k = o.k AND a.side = 'edit' JOIN j b ON b.k = o.k AND b.side = 'orig'")
def ablation_examples(spark, sf_dir):
    return grounding.as_dataset(grounding.ablation_pairs(_citing(spark, sf_dir)))


@query("SELECT item_id AS k, md5(item_id || chr(10) || 'Context ' || item_id || chr(10) || lower(text) || chr(10) || '<p>one' || chr(10) || '<p>' || item_id || chr(10) || 'n/a' || chr(10)) AS record FROM benchmark")
def cstr_records(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("counter"), F.concat(F.lit("Context "), "item_id").alias("context"), F.col("text").alias("target"), F.array(F.lit("one"), F.col("item_id").cast("string")).alias("groundings"), F.lit("n/a").alias("control"))
    return rows.select(F.col("counter").alias("k"), F.md5(sinks.cstr_record().cast("binary")).alias("record"))


@query("SELECT DISTINCT source AS context, lang AS grounding_true, source AS grounding_false, md5(text) AS target FROM documents WHERE NOT contains(text, '|') AND length(text) >= 50 AND ends_with(text, '.')")
def natural_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("grounding_true"), F.col("source").alias("grounding_false"), F.col("source").alias("context"), F.col("text").alias("target"))
    return scoring.load_natural(rows).withColumn("target", F.md5(F.col("target").cast("binary")))


@query("""
WITH b AS (SELECT item_id, md5(text) AS t, 's' || item_id AS s, 'n' || item_id AS n FROM benchmark WHERE item_id NOT IN (3, 14))
SELECT t AS context, s AS grounding_true, n AS grounding_false, 'old' AS target FROM b UNION ALL SELECT t, n, s, 'new' FROM b
""")
def synthetic_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.md5(F.col("text").cast("binary")).alias("context"), F.concat(F.lit("s"), "item_id").alias("source"), F.concat(F.lit("n"), "item_id").alias("new_source"), F.lit("old").alias("target"), F.lit("new").alias("new_target"))
    return scoring.load_synthetic(rows, skip=(3, 14)).select("context", "grounding_true", "grounding_false", "target")


@query("SELECT user_id, arg_min(event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END * 1000000000::BIGINT + event_id) AS event_id FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY user_id")
def first_hits(spark, sf_dir):
    """Of each user the first event of the best kind that there is."""
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type").isin("purchase", "click", "view"), F.col("event_id")).alias("event_id"), F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2).alias("rank"))
    return grounding.first_hit(rows, "user_id", ["rank", "event_id"], "event_id")


@query("SELECT count(*) AS tried, count(*) FILTER (WHERE page_id % 3 = 0) AS failed, count(*) FILTER (WHERE page_id % 3 = 1) AS empty, count(*) FILTER (WHERE page_id % 3 = 2) AS found FROM pages")
def fetch_outcomes(spark, sf_dir):
    def get(row: dict) -> dict | None:
        if row["page_id"] % 3 == 0:
            raise OSError("gone")
        return {"url": row["url"], "html": "x"} if row["page_id"] % 3 == 2 else None

    return dumps.fetch_counts(dumps.fetch_tried(table(spark, sf_dir, "pages").select("page_id", "url"), get))


@query("SELECT doc_id, CAST(unnest(range(0, doc_id % 3)) AS INTEGER) AS k FROM documents")
def flat_mapped(spark, sf_dir):
    """Steps that give no row, one row or several rows for each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(3)).cast("int").alias("k"))
    return chain(rows, [flat_map("k", lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)))])


@query("SELECT doc_id, source AS a FROM documents")
def projected(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumns({"a": F.col("source"), "src_x": F.lit(1), "src_y": F.lit(2)})
    return chain(rows, [edits.drop_prefix("src_"), edits.project(["doc_id", "a", "src_x", "nowhere"])])


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, CAST(-1 AS INTEGER) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def backed_up_results(spark, sf_dir):
    have = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return dumps.merge_results(have, table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality")), "doc_id")


def _dump(spark, sf_dir) -> str:
    """The conversations as an XML dump in the shared folder."""
    rows = table(spark, sf_dir, "conversations")
    made = rows.select(F.concat(F.lit("Page "), "conv_id").alias("page_title"), F.col("conv_id").alias("page_id"), F.col("turn").alias("seq"), (F.col("conv_id") * 1000 + F.col("turn")).alias("rev_id"), (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_id"), F.lit("2020-01-01T00:00:00Z").alias("timestamp"), F.col("role").alias("username"), F.concat(F.lit("/* <a> */ & "), "role").alias("comment"), "text")
    path = sinks.scratch_dir(spark, "dump")
    sinks.write_dump(made, path, "bzip2")
    return path


_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"SELECT 'Page ' || conv_id AS page_title, CAST(conv_id AS VARCHAR) AS page_id, CAST(conv_id * 1000 + turn AS VARCHAR) AS rev_id, CAST(conv_id * 1000 + turn - 1 AS VARCHAR) AS parent_id, role AS username, '/* &lt;a&gt; */ &amp; ' || role AS comment, md5({_ESCAPED.format('text')}) AS text_md5 FROM conversations")
def dump_revisions(spark, sf_dir):
    """The tables' revisions, written as a compressed dump and read back in splits."""
    rows = dumps.read_revisions(spark, _dump(spark, sf_dir))
    return rows.select("page_title", "page_id", "rev_id", "parent_id", "username", "comment", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"SELECT * FROM (SELECT CAST(conv_id AS VARCHAR) AS page_id, CAST(conv_id * 1000 + turn AS VARCHAR) AS rev_id, md5({_ESCAPED.format('lag(text) OVER w')}) AS src_md5, md5({_ESCAPED.format('text')}) AS tgt_md5, row_number() OVER w AS nth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE nth > 1".replace("SELECT * FROM", "SELECT page_id, rev_id, src_md5, tgt_md5 FROM"))
def dump_pairs(spark, sf_dir):
    """Consecutive revisions of a dump's pages."""
    pairs = edits.revision_pairs(dumps.read_revisions(spark, _dump(spark, sf_dir)))
    return pairs.select("page_id", "rev_id", *[F.md5(F.col(f"{s}_text").cast("binary")).alias(f"{s}_md5") for s in ("src", "tgt")])


@query(f"SELECT CAST(conv_id AS VARCHAR) AS id, max(CAST(conv_id * 1000 + turn AS VARCHAR)) AS revid, 'Page ' || conv_id AS title, '0' AS ns, md5(arg_max(trim(text, ' ' || chr(9) || chr(10) || chr(13)), turn)) AS text_md5 FROM conversations GROUP BY conv_id".replace("max(CAST(conv_id * 1000 + turn AS VARCHAR))", "CAST(max(conv_id * 1000 + turn) AS VARCHAR)"))
def dump_pages(spark, sf_dir):
    """The latest revision of each page of a dump, unescaped."""
    pages = dumps.read_pages(spark, _dump(spark, sf_dir))
    return pages.select("id", "revid", "title", "ns", F.md5(F.btrim("text", F.lit(" \t\n\r")).cast("binary")).alias("text_md5"))


@query("SELECT count(*) AS pages, CAST(sum(n) AS BIGINT) AS revisions FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def dump_page_blocks(spark, sf_dir):
    """Whole page elements, and the revisions in them."""
    blocks = dumps.page_blocks(spark, _dump(spark, sf_dir))
    return blocks.agg(F.count(F.lit(1)).alias("pages"), F.sum(F.regexp_count("page", F.lit("<revision>"))).cast("long").alias("revisions"))


def _sentence_lists(spark, sf_dir) -> DataFrame:
    """Orders as two sentences on the source side; as target both (kind 0), both swapped (1), the second alone (2), the first twice (3)."""
    o = table(spark, sf_dir, "orders").withColumn("kind", F.pmod("o_orderkey", F.lit(4)))
    a = F.array(*[F.concat(F.lit(f"a{i}_"), "o_orderkey") for i in range(5)])
    b = F.array(*[F.concat(F.lit(f"b{i}_"), "o_orderstatus") for i in range(6)])
    target = F.when(F.col("kind") == 0, F.array(a, b)).when(F.col("kind") == 1, F.array(b, a)).when(F.col("kind") == 2, F.array(b)).otherwise(F.array(a, a))
    return o.select("o_orderkey", "kind", F.array(a, b).alias("src_sents"), target.alias("tgt_sents"))


@query("SELECT o_orderkey, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['0>0', '1>1'] WHEN 1 THEN ['0>1', '1>0'] WHEN 2 THEN ['1>0'] ELSE ['0>0,1'] END) AS matched FROM orders")
def aligned_sentences(spark, sf_dir):
    """Groups of matching sentences, as connected components."""
    rows = edits.align_sentences(5, 0.5, 2)(_sentence_lists(spark, sf_dir))
    shown = lambda c: F.array_join(F.col(f"{c}.numbers").cast("array<string>"), ",")
    return rows.select("o_orderkey", F.concat(shown("source"), F.lit(">"), shown("target")).alias("matched"))


@query("SELECT o_orderkey, CAST(unnest([0, 1]) AS INTEGER) AS i, unnest(CASE o_orderkey % 4 WHEN 0 THEN [1.0::DOUBLE, 1.0] WHEN 1 THEN [1.0, 1.0] WHEN 2 THEN [0.0, 1.0] ELSE [1.0, 0.0] END) AS score, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['b', 'b'] ELSE ['a', 'a'] END) AS target FROM orders")
def best_matches(spark, sf_dir):
    """Of each source sentence the target sentence with the best BLEU, of equal ones the first."""
    rows = edits.match_sentences(5, 2)(_sentence_lists(spark, sf_dir))
    return rows.select("o_orderkey", "i", F.round("match_score", 6).alias("score"), F.substring("target.sentence", 1, 1).alias("target"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY min(turn), conv_id LIMIT 30)")
def first_pages(spark, sf_dir):
    return filters.first_pages(30, "conv_id", ["turn"])(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 2 THEN 0 WHEN 3 THEN 5 END AS before, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS left_over FROM orders
""")
def trimmed_sides(spark, sf_dir):
    """Sentences that both sides share at their starts and ends go, by turns, until no side has over ten of its eleven tokens.

    A turn takes one from the start and one from the end; where none are shared, the sides stay too long: null.
    """
    rows = _sentence_lists(spark, sf_dir).withColumn("t", windows.trimmed_column("src_sents", "tgt_sents", 10))
    left = F.when(F.col("t.source").isNull(), 2).otherwise(F.size("t.source"))
    return rows.select("o_orderkey", F.col("t.before").alias("before"), left.alias("left_over"))


@query("SELECT page_id, url, md5(html) AS html_md5 FROM pages WHERE page_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233)")
def stored_pages(spark, sf_dir):
    """All pages written to a store, and a few found in it by their ids, one of them asked for twice, one not there."""
    path = sinks.scratch_dir(spark, "store")
    stores.write_page_store(table(spark, sf_dir, "pages"), path, "page_id", buckets=8)
    found = stores.find_pages(spark, path, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 1, -7, None], "page_id")
    return found.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query("SELECT 'T&' || doc_id AS title, CASE doc_id % 3 WHEN 0 THEN '10' ELSE '828' END AS ns, CAST(doc_id AS VARCHAR) AS id, md5(coalesce(text, '')) AS text_md5 FROM documents WHERE doc_id % 3 < 2")
def template_files(spark, sf_dir):
    """Documents as templates, modules and articles: the first two are written as page elements and read back."""
    path, kind = sinks.scratch_dir(spark, "templates"), F.pmod("doc_id", F.lit(3))
    ns = F.when(kind == 0, "10").when(kind == 1, "828").otherwise("0")
    stores.write_templates(table(spark, sf_dir, "documents").select(F.concat(F.lit("T&"), "doc_id").alias("title"), ns.alias("ns"), F.col("doc_id").alias("id"), "text"), path)
    return stores.read_templates(spark, path).select("title", "ns", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT url AS key, page_id AS n, md5(html) AS html_md5 FROM pages WHERE url IS NOT NULL")
def json_maps(spark, sf_dir):
    """Pages by URL as JSON objects, one a file, and back."""
    path = sinks.scratch_dir(spark, "maps")
    rows = table(spark, sf_dir, "pages").select("url", F.struct(F.col("page_id").alias("n"), "html").alias("page"))
    stores.write_json_map(rows, "url", "page", path, files=3)
    return stores.read_json_map(spark, path, "struct<n:bigint,html:string>").select("key", F.col("value.n").alias("n"), F.md5(F.col("value.html").cast("binary")).alias("html_md5"))


@query("SELECT CAST(doc_id AS VARCHAR) AS line, CAST(strlen(coalesce(text, '')) AS INTEGER) AS bytes, true AS fits FROM documents")
def sized_files(spark, sf_dir):
    """Documents, a line each, in files of at most 100 kB; fits: whether a line's file holds so much, or one line alone."""
    path = sinks.scratch_dir(spark, "sized")
    flat = F.concat_ws(" ", "doc_id", F.translate(F.coalesce("text", F.lit("")), "\n\r", "  "))
    stores.write_sized(table(spark, sf_dir, "documents"), path, flat, 100_000)
    rows = spark.read.text(path)
    size = rows.groupBy("part", "file").agg(F.sum(F.octet_length("value") + 1).alias("size"), F.count(F.lit(1)).alias("n"))
    line = F.substring_index("value", " ", 1)
    return rows.join(size, ["part", "file"]).select(line.alias("line"), (F.octet_length("value") - F.length(line) - 1).alias("bytes"), ((F.col("size") <= 100_000) | (F.col("n") == 1)).alias("fits"))


@query("SELECT page_id, CASE page_id % 3 WHEN 2 THEN url END AS html, CASE page_id % 3 WHEN 0 THEN 'OSError: gone' WHEN 1 THEN 'empty' END AS error, CAST(CASE page_id % 3 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS round FROM pages")
def resumed_fetches(spark, sf_dir):
    """Three rounds of fetches, in two runs over one table of results: what failed is tried again, what was found or empty isn't."""

    def get(row: dict) -> dict | None:
        if row["page_id"] % 3 == 0:
            raise OSError("gone")
        return {"html": row["url"]} if row["page_id"] % 3 == 2 else None

    path, wanted = sinks.scratch_dir(spark, "fetches"), table(spark, sf_dir, "pages").select("page_id", "url")
    stores.fetch_missing(wanted, path, get, key="page_id", rounds=1)
    return stores.fetch_missing(wanted, path, get, key="page_id", rounds=2)


@query("""
SELECT '[7] ' || o_orderkey || '/' || o_custkey || '^order^' || o_orderstatus || '^' || CASE o_orderkey % 4 WHEN 0 THEN '[10|13]^[]^[4,5,6]' WHEN 3 THEN '[10|13]^[]^[4,5,6]' WHEN 1 THEN '[10|14]^[]^[4,5,6,12]' ELSE '[10|13]^[3]^[3,4,5,6]' END AS line FROM orders
""")
def sample_lines(spark, sf_dir):
    """A log line for each edit."""
    found = edits.token_diff(_edited_orders(spark, sf_dir)).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    line = text.sample_line(F.lit(7), F.col("o_orderkey"), F.col("o_custkey"), [F.lit("order"), F.col("o_orderstatus")], F.col("src_tokens"), F.col("tgt_tokens"), F.col("src_token_diff"), F.col("tgt_token_diff"))
    return found.select(line.alias("line"))


@query("SELECT o_orderkey, 'meta-history1.xml-p' || o_orderkey || 'p' || o_custkey AS name FROM orders")
def output_names(spark, sf_dir):
    """Names of dump files cut down to what tells them apart."""
    path = F.concat(F.lit("s3a://d/dumps/enwiki-20190801-pages-xxxx-meta-history1.xml-p"), "o_orderkey", F.lit("p"), "o_custkey", F.lit(".bz2"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.output_name(path).alias("name"))


@query("SELECT n_name AS id, 'x/' || n_name || '/paths.gz' AS paths, 'y/cdx-' || n_name || '.gz' AS url FROM nation")
def crawl_listing(spark, sf_dir):
    """A listing of crawls, and the index files that the lists of each one name."""
    path = sinks.scratch_dir(spark, "listing")
    listed = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_name").alias("id"), F.lit("x").alias("name"))).alias("value"))
    whole = listed.agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value"))
    whole.write.text(path)
    found = stores.read_collections(spark, path, "x/{}/paths.gz")
    lines = found.select("id", "paths", F.explode(F.array(F.concat(F.lit(" cdx-"), "id", F.lit(".gz\t")), F.concat(F.lit("warc-"), "id"))).alias("value"))
    return stores.index_urls(lines, "y/{}").select("id", "paths", "url")
