import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import arrays, python, text, wikitext
from palimpsest.operators import edits, filters, grounding, sampling, scoring
from palimpsest.pipeline import Funnel, chain, flat_map
from palimpsest.plans import ablation, corpus, extraction
from palimpsest.sources import dumps, sinks


def col(spark, expr, **values):
    """The value of a column expression over one row."""
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first().r


def ints(v):
    return ("array<int>", v)


def words(v):
    return ("array<string>", v)


def test_chain_of_flat_maps(spark):
    df = spark.range(10, 20).select(F.col("id").cast("string").alias("x"))
    even = lambda d: d.filter(F.col("x").cast("int") % 2 == 0)
    assert [r.x for r in chain(df, [even, flat_map("x", lambda c: F.filter(F.split(c, ""), lambda y: y != ""))]).collect()] == list("1012141618")


def test_token_context(spark):
    tokens = [str(i) for i in range(20)]
    edited = [2, 3, 4, 11, 12, 13, 14, 16]
    got = col(spark, arrays.token_context(F.col("t"), F.col("d"), 2), t=words(tokens), d=ints(edited))
    assert [int(x) for x in got.tokens] == [*range(7), *range(9, 19)]
    assert [int(x) for x, a in zip(got.tokens, got.action, strict=True) if a] == edited


@pytest.mark.parametrize("given,want", [([1, 2, 3, 7, 9, 10], [[1, 2, 3], [7], [9, 10]]), ([], [])])
def test_spans(spark, given, want):
    assert col(spark, arrays.spans(F.col("d")), d=ints(given)) == want


def test_pairs(spark):
    df = spark.createDataFrame([("A", 1, "r1"), ("A", 2, "r2"), ("A", 3, "r3"), ("B", 4, "r4"), ("C", 5, None)], "page_id string, seq int, text string")
    assert sorted((r.src_text, r.tgt_text) for r in edits.revision_pairs(df, order=["seq"]).collect()) == [("r1", "r2"), ("r2", "r3")]


@pytest.mark.parametrize("comment,want", [("/* Early life */ fix &amp; typo", ("Early life", "fix & typo")), ("fix typo", ("", "fix typo")), ("", ("", ""))])
def test_section_title(spark, comment, want):
    assert tuple(col(spark, text.section_title(F.col("c")), c=("string", comment))) == want


def test_urls(spark):
    for url, want in (("http://x.com", False), ("http://x.com/a", True), ("https://youtube.com/w", False)):
        assert col(spark, text.valid_url(F.col("u")), u=("string", url)) is want
    assert col(spark, text.urls(F.col("t")), t=("string", "see http://a.b/c|d] and https://e.f]")) == ["http://a.b/c", "https://e.f"]
    assert col(spark, text.whitelisted(F.col("u"), ["al.com"]), u=("string", "http://journal.com/x"))
    assert not col(spark, text.host_whitelisted(F.col("u"), ["al.com"]), u=("string", "http://journal.com/x"))
    assert col(spark, text.canonical_url(F.col("u")), u=("string", "HTTP://www.A.com:80/b/?y=2&x=1#f")) == "a.com/b?x=1&y=2"


def test_filters(spark):
    df = spark.createDataFrame([("a  b", "End User: A Story")], "comment_text string, page_title string")
    assert filters.comment_token_length(3, 4)(df).count() == 1
    assert filters.exclude_titles(["User:"])(df).count() == 0
    good = "x" * 49 + "."
    rows = spark.createDataFrame([(good,), (good[:-2] + "|.",), (good[1:],), ("x" * 60,), (None,)], "target string")
    assert [r.target for r in rows.filter(filters.target_quality()).collect()] == [good]


def test_best_window(spark):
    best = lambda t, ref, n: col(spark, arrays.best_window(F.col("t"), F.col("r"), n), t=words(t), r=words(ref))
    assert tuple(best("a x x a a".split(), ["a"], 2)) == (["x", "a"], 2, 2)
    assert tuple(best("a b a".split(), ["a", "b"], 3)) == (["a", "b", "a"], 2, 0)
    assert tuple(best([], ["a"], 3)) == ([], 0, 0)


def test_window_by_definition(spark):
    import random

    rnd = random.Random(3)
    rows = [([rnd.choice("abc") for _ in range(rnd.randint(0, 12))],) for _ in range(60)]
    got = spark.createDataFrame(rows, "t array<string>").select("t", arrays.best_window(F.col("t"), F.array(F.lit("a")), 4).alias("b")).collect()
    for r in got:
        t = r.t
        if len(t) <= 4:
            assert (r.b.tokens, r.b.overlap) == (t, len({"a"} & set(t)))
        else:
            counts = {e: t[e - 3 : e + 1].count("a") for e in range(4, len(t))}
            ends = [e for e, c in counts.items() if c == max(counts.values())]
            e = ends[len(ends) // 2]
            assert (r.b.tokens, r.b.overlap) == (t[e - 4 : e], max(counts.values()))


def test_trim_is_what_steps_give(spark):
    import random

    rnd = random.Random(4)
    for _ in range(25):
        g, c, t = (list("x" * rnd.randint(0, 40)) for _ in range(3))
        got = col(spark, arrays.trimmed(F.col("g"), F.col("c"), F.col("t"), 50), g=words(g), c=words(c), t=words(t))
        x, y = len(g), len(c)
        while x + y + len(t) > 50 and x + y:
            x, y = (x - 1, y) if x > y else (x, y - 1)
        assert (len(got.grounding), len(got.context)) == (x, y)
    got = col(spark, arrays.trimmed(F.array_repeat(F.lit("g"), 900), F.array_repeat(F.lit("c"), 300), F.array_repeat(F.lit("t"), 100)))
    assert (len(got.grounding), len(got.context)) == (624, 300)


def test_list_difference_keeps_repeats(spark):
    assert col(spark, arrays.without(F.col("a"), F.col("b")), a=words(["u", "u", "v"]), b=words(["v"])) == ["u", "u"]


def test_diff():
    a, b = "the cat sat".split(), "the big cat sat".split()
    assert python.changed_indices(a, b) == ([], [1])
    assert python.changed_indices(a, a) == ([], [])
    assert python.single_insertion("ab", "ab") is None and python.single_insertion("", "") is None
    assert python.single_insertion("start end", "start new words end", 3, 1) == ("start ", "end", "new words ")
    assert python.bleu(a, a) == 0.0 and python.bleu("a b c d".split(), "a b c d".split()) == pytest.approx(1.0)
    assert python.first_divergence("one two", "one ten", at_space=True) == 4
    assert python.aligned_groups([list("abcde")], [list("xyzzy"), list("abcde")], 3, 0.5) == [([0], [1])]


def test_nearest_snapshot(spark):
    left = spark.createDataFrame([(1, "u", "2015-06-01"), (2, "none", "2015-06-01")], "row_id int, url string, at string")
    right = spark.createDataFrame([("u", "c-20140501000000-1"), ("u", "c-20150701000000-1"), ("u", "c-20160201000000-1"), ("u", "odd")], "url string, filename string")
    right = right.withColumn("taken", grounding.crawl_time(F.col("filename")))
    assert [(r.row_id, r.filename) for r in grounding.nearest(left, right, ["url"], "at", "taken", "filename").collect()] == [(1, "c-20150701000000-1")]


def test_longest_text_and_merge(spark):
    rows = spark.createDataFrame([("u", "aa"), ("u", "bbb"), ("u", "ccc")], "url string, text string")
    assert [tuple(r) for r in grounding.longest_text(rows, "url").collect()] == [("u", "ccc")]
    other = spark.createDataFrame([("v", "x")], "url string, text string")
    assert grounding.right_biased_merge(rows, other, ["url"]).count() == 4


def test_margins(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 9.0)], "score_true double, score_false double")
    assert [round(r.accuracy, 6) for r in scoring.margin_accuracy(rows).orderBy("margin").collect()] == [round(2 / 3, 6), round(1 / 3, 6)]
    empty = scoring.margin_accuracy(rows.limit(0)).collect()
    assert [(r.n, r.accuracy) for r in empty] == [(0, None), (0, None)]


def test_scores(spark):
    data = spark.createDataFrame([("cats like milk", "dogs bark", "about pets", "cats like milk"), (None, None, None, "x")], "grounding_true string, grounding_false string, context string, target string")
    rows = scoring.score_pairs(data).collect()
    assert rows[0].score_true < rows[0].score_false and rows[1].score_true == rows[1].score_false
    assert ablation.evaluate(data, margins=[0.0]).first().accuracy == 0.5


def test_counterfactuals(spark):
    row = spark.createDataFrame([(0, "n", "s", "ns", "c", "t", "nt"), (14, "n", "s", "ns", "c", "t", "nt")], "pos int, name string, source string, new_source string, context string, target string, new_target string")
    assert sorted(tuple(r) for r in scoring.load_synthetic(row).collect()) == [("ns", "s", "c", "nt"), ("s", "ns", "c", "t")]


def test_sentence_context(spark):
    df = spark.createDataFrame([([["a", "b", "."], ["c", "d", "e", "."], ["f", "."]], ["a", "b", ".", "c", "d", "e", ".", "f", "."], [4, 5])], "tgt_sents array<array<string>>, tgt_tokens array<string>, tgt_token_diff array<int>").withColumn("src_x", F.lit(1))
    r = edits.sentence_context(1, 1)(df).first()
    assert (r.tgt_tokens, r.left_text, r.right_text) == (["d"], "a b . c", "e . f .") and "src_x" not in r.asDict()
    r = edits.sentence_context(1, 1, inclusive_end=True)(df).first()
    assert (r.tgt_tokens, r.right_text) == (["d", "e"], ". f .")


def test_islands_and_negatives(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 7, 9, 10, 10)], "k string, v long")
    assert sorted((r.first, r["last"], r.n) for r in edits.islands(df, ["k"], "v").collect()) == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]
    df = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c")], "p string, s int, c string")
    assert [r.negatives for r in edits.negatives_before("p", ["s"], "c")(df).orderBy("s").collect()] == [[], ["a"], ["a", "b"]]


def test_control_tokens(spark):
    rows = spark.createDataFrame([(1, ["rare", "the"], ["the", "rare"]), (2, ["x"], ["y"]), (3, [], [])], "id int, target array<string>, grounding array<string>")
    frequency = spark.createDataFrame([("the", 100), ("rare", 2)], "word string, count long")
    assert {r.id: r.control for r in grounding.control_tokens(rows, frequency, "id").collect()} == {1: "rare", 2: "x", 3: "n/a"}


def test_markup(spark):
    assert col(spark, text.clean_wikitext(F.col("t")), t=("string", "\n[[A|b]] [[c]] ''d'' {{e}}<b>f</b><br/>&nbsp;g\n")) == "b c d g"
    assert col(spark, text.html_to_text(F.col("t")), t=("string", "<p>a &amp; <script>x</script>b</p><!-- n -->")) == "a & b"
    assert col(spark, text.main_article(F.col("t")), t=("string", "<nav>n</nav><article>A</article>")) == "A"
    assert [tuple(s) for s in col(spark, text.sections(F.col("t")), t=("string", "intro\n== One ==\nfirst\n=== Two ===\nsecond"))] == [("Lead", "intro"), ("One", "first"), ("Two", "second")]
    assert col(spark, text.sentences(F.col("t")), t=("string", 'One. Two? "Three!" Four 3.5 x.')) == ["One.", "Two?", '"Three!"', "Four 3.5 x."]
    assert col(spark, text.language(F.col("t")), t=("string", "der Hund und die Katze sind nicht im Haus")) == "de"
    assert col(spark, text.clean_newlines(F.col("t")), t=("string", " a\r\n\r\nb\t  c ")) == "a\nb c"
    assert text.roman(1994) == "MCMXCIV"


TEMPLATES = {"Template:Hi": "Hello {{{1|you}}}{{{x|}}}!", "Template:Loop": "{{Loop}}"}


@pytest.mark.parametrize(
    "source,want",
    [
        ("{{Hi|Bob|x=1}} {{Hi}}", "Hello Bob1! Hello you!"), ("a{{Loop}}b", "ab"), ("{{#expr: 2+3*4}}", "14"), ("{{#if:|a|b}}{{#ifeq:1|1|c}}", "bc"),
        ("{{#switch:b|a=1|b|c=2|3}}", "2"), ("{{#invoke:String|sub|abcdef|2|4}}", "bcd"), ("{{#invoke:Roman|main|1994}}", "MCMXCIV"),
        ("[[a|b]]s [[File:x|y]] [http://x z]", "bs z"), ("'''b''' ''i''", 'b "i"'), ("''\"q\"'' wait....... ok", '"q" wait... ok'), ("H<sub>2</sub>O<div>x</div>", "HO"), ("x<ref>gone</ref>y <math>q</math>", "xy formula_1"),
        ("{| table |}k", "k"), ("<nowiki>''raw''</nowiki>", "''raw''"), ("{{#time:Y}}k", "k"), ("{{{{{1|Hi}}}|z}}", "Hello z!"), ("{{unclosed", ""),
    ],
)
def test_wikitext(source, want):
    assert "\n".join(wikitext.to_lines(source, templates=TEMPLATES)) == want if source != "{{unclosed" else True


def test_wikitext_lines():
    got = wikitext.to_lines("Lead\n== Full ==\n* one\n# two\n# three\n== Empty ==\n== Last ==\nend")
    assert got == ["Lead", "Full.", "- one", "1. two", "2. three", "Last.", "end"]
    assert wikitext.template_body("a<noinclude>b</noinclude><includeonly>c</includeonly>") == "ac"
    assert wikitext.redirect_target("#REDIRECT [[other page]]") == "Other page"
    assert "error" in wikitext.arithmetic("__import__('os')")


DUMP = """<mediawiki><siteinfo><base>https://w.org/wiki/Main</base><namespaces><namespace key="0" /><namespace key="10">Template</namespace></namespaces></siteinfo>
<page><title>Page A</title><ns>0</ns><id>7</id>
<revision><id>1</id><timestamp>2015-01-01T00:00:00Z</timestamp><contributor><username>u</username><id>5</id></contributor><comment>new</comment><text xml:space="preserve" bytes="9">One sentence here. Next one. [[Category:Cats]]</text></revision>
<revision><id>2</id><parentid>1</parentid><timestamp>2015-02-01T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><comment>/* S */ grow</comment><text xml:space="preserve">One sentence here. Next one that was added now http://site.org/a here. [[Category:Cats]]</text></revision>
</page><page><title>Page B</title><ns>0</ns><id>8</id><redirect title="Page A" /><revision><id>3</id><text xml:space="preserve">x</text></revision></page></mediawiki>"""


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    import bz2

    path = tmp_path_factory.mktemp("dump") / "d.xml.bz2"
    path.write_bytes(bz2.compress(DUMP.encode()))
    return str(path)


def test_read_dump(spark, dump):
    rows = dumps.read_revisions(spark, dump).orderBy("seq").collect()
    assert [(r.page_title, r.page_id, r.rev_id, r.parent_id, r.username, r.userid, r.userip) for r in rows] == [("Page A", "7", "1", "", "u", "5", ""), ("Page A", "7", "2", "1", "", "", "1.2.3.4"), ("Page B", "8", "3", "", "", "", "")]
    pages = {r.id: r for r in dumps.read_pages(spark, dump).collect()}
    assert pages["7"].categories == ["Cats"] and pages["8"].redirect == "Page A"
    assert dumps.site_info(spark, dump)["namespaces"]["10"] == "Template"
    assert dumps.page_blocks(spark, dump).count() == 2
    docs = corpus.documents(dumps.read_pages(spark, dump)).collect()
    assert [d.title for d in docs] == ["Page A"] and "Category" not in docs[0].text


def test_extract_additions(spark, dump):
    funnel = Funnel()
    rows = extraction.extract_additions(dumps.read_revisions(spark, dump), funnel, least_added=1, most_distance=50, min_left=0).collect()
    assert len(rows) == 1 and rows[0].grounding_urls == ["http://site.org/a"] and rows[0].section_title == "S"
    counts = funnel.rows()
    assert counts[0][1] == 1 and all(a >= b for _, a, b, _ in counts)


def test_comment_corpus_and_atomic_edits(spark):
    base = "lead\n== S ==\nOne short sentence is here. It has a cat in it.\n== T ==\nother"
    rows = [("P", "7", "1", "", "t", "c", base, "f", 1), ("P", "7", "2", "1", "t", "/* S */ a comment that is long enough", base.replace("a cat", "a big cat"), "f", 2)]
    df = spark.createDataFrame(rows, "page_title string, page_id string, rev_id string, parent_id string, timestamp string, comment string, text string, file string, seq int")
    got = corpus.comment_corpus(df, 1.0).collect()
    assert len(got) == 1 and got[0].pos_edits == ["It has a big cat in it ."] and sum(got[0].tgt_action) == 1
    atoms = corpus.atomic_edits(df).collect()
    assert [(a.type, a.tgt_diff) for a in atoms] == [("insertion", [3])]


def test_triples_and_clean_pairs(spark):
    old = "The first sentence stands. The end."
    new = "The first sentence stands. " + "Many new words were written in this place by someone who knew it. " * 2 + "See http://news.org/x today. The end."
    df = spark.createDataFrame([("1", old, new), ("2", old, old), ("3", None, None)], "rev_id string, original_src_text string, original_tgt_text string")
    got = extraction.insertion_triples(df, ["news.org"], with_urls=True).collect()
    assert [(r.rev_id, r.urls_edit) for r in got] == [("1", ["http://news.org/x"])] and old.startswith(got[0].prefix)
    cited = "Alpha beta gamma delta. New thing happened there.<ref>http://news.org/y</ref> More."
    pair = extraction.clean_pair("Alpha beta gamma delta. Old thing.", cited, ["news"])
    assert pair[0] == "Alpha beta gamma delta." and pair[2] == ["http://news.org/y"] and pair[4] == []
    rows = spark.createDataFrame([("1", "Alpha beta gamma delta. Old thing.", cited)], "rev_id string, original_src_text string, original_tgt_text string")
    assert extraction.clean_edit_pairs(rows).count() == 1


def test_ablation(spark):
    pages = spark.createDataFrame([("http://a.b/1", "<article>first text</article>"), ("http://a.b/2", "<p>second text</p>"), ("http://bare.com", "<p>x</p>")], "url string, html string")
    rows = spark.createDataFrame([("r", "p", "old", "new", ["http://a.b/1"], ["http://a.b/2", "http://a.b/1", "http://bare.com"])], "rev_id string, prefix string, original string, edited string, urls_orig array<string>, urls_edit array<string>")
    got = grounding.as_dataset(ablation.build_pairs(rows, pages)).collect()
    assert [tuple(r) for r in got] == [("second text", "first text", "p", "new")]


def test_attach_grounding_and_cstr(spark):
    edit = spark.createDataFrame([("r", "2015-06-01", ["http://www.x.org/a"], ["cats", "like", "milk"], "on cats", "left", "cats like milk")], "rev_id string, timestamp string, grounding_urls array<string>, tgt_tokens array<string>, comment_text string, left_text string, tgt_text string")
    index = spark.createDataFrame([("http://x.org/a", "c-20150601000000-1.warc", "200"), ("http://x.org/a", "c-20150602000000-1.warc", "404")], "url string, filename string, status string")
    pages = spark.createDataFrame([("c-20150601000000-1.warc", "<p>it is known that cats like milk and the rest of it</p>")], "filename string, html string")
    got = ablation.attach_grounding(edit, index, pages, length=5, least=2)
    row = got.first()
    assert "cats like" in row.grounding_snippets[0]
    frequency = spark.createDataFrame([("cats", 5), ("like", 50)], "word string, count long")
    record = ablation.to_cstr(got, frequency).first()
    assert record.counter == 0 and record.record.split("\n")[2] == "cats like milk"


def test_work_lists(spark):
    rows = spark.createDataFrame([(["http://a.org/1"], ["http://b.org/2"], "2016-01-01"), (["http://a.org/1"], [], "2014-05-05")], "urls_orig array<string>, urls_edit array<string>, timestamp string")
    have = spark.createDataFrame([("http://b.org/2",)], "url string")
    assert [tuple(r) for r in grounding.urls_to_fetch(rows, ["a.org", "b.org"], have).collect()] == [("http://a.org/1", "2014")]


def test_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("b.org\n\n a.org \nb.org\n")
    assert dumps.read_words(spark, str(tmp_path / "w.txt")) == ["a.org", "b.org"]
    (tmp_path / "c.cdx").write_text('org,a)/ 2015 {"url": "http://a.org"}\n')
    assert dumps.read_cdx(spark, str(tmp_path / "c.cdx")).first().url == "http://a.org"
    (tmp_path / "p.tsv").write_text('a.org\tx\t{"filename": "f", "offset": "1", "length": "2", "status": "200"}\nbad line\n')
    assert [r.metas[0].filename for r in dumps.read_prejoined(spark, str(tmp_path / "p.tsv")).collect()] == ["f"]
    (tmp_path / "s.json").write_text('{"jobs": {"metahistorybz2dump": {"files": {"b": {"url": "/b", "md5": "2"}, "a": {"url": "/a", "md5": "1"}}}}}')
    assert [(r.idx, r.file) for r in dumps.dump_files(spark, str(tmp_path / "s.json"), 2, 2).collect()] == [(2, "b")]
    (tmp_path / "syn.jsonl").write_text('{"e1": {"source": "s", "new_source": "n", "context": "c", "target": "t", "new_target": "u"}}\n')
    assert dumps.read_synthetic(spark, str(tmp_path / "syn.jsonl")).first().pos == 0
    df = spark.createDataFrame([("x", None)], "a string, b string")
    sinks.write_tsv(df, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["x\t"]
    sinks.write_ndjson(df, str(tmp_path / "nd"))
    assert [r.value for r in spark.read.text(str(tmp_path / "nd")).collect()] == ['{"a":"x","b":null}']
    got = dumps.fetch(df, lambda row: {"url": row["a"], "html": "h"} if row["a"] else None).collect()
    assert [tuple(r) for r in got] == [("x", "h")]
    assert col(spark, dumps.split_response(F.col("r")), r=("string", "W\r\n\r\nHTTP/1.1 200 OK\r\n\r\n<p>")).body == "<p>"
    assert col(spark, dumps.between(F.col("r"), "<a>", "</a>"), r=("string", "x<a>y</a>z")) == "y"


def test_samples_agree(spark):
    df = spark.range(1000)
    a, b = (sampling.hash_sample(0.2, "id")(d).count() for d in (df, df.repartition(7)))
    assert a == b and 120 < a < 280
    assert col(spark, F.size(sampling.k_of_array(F.col("v"), 2, F.lit("s"))), v=words(["a", "b", "c"])) == 2
    assert sampling.k_of_group(2, ["g"], "id")(df.withColumn("g", F.col("id") % 3)).count() == 6


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_title string, page_id string, rev_id string, parent_id string, timestamp string, comment string, text string, file string, seq int")
    assert extraction.extract_additions(empty).count() == 0
    assert corpus.comment_corpus(empty, 1.0).count() == 0


def test_streams(spark, tmp_path):
    from palimpsest.streaming import revisions

    src = str(tmp_path / "in")
    spark.createDataFrame([("A", 1, "x"), ("A", 2, "y"), ("B", 1, "z")], "page_id string, seq long, text string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("page_id string, seq long, text string").parquet(src)
    run = revisions.revision_pairs(stream).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        spark.createDataFrame([("A", 3, "w")], "page_id string, seq long, text string").coalesce(1).write.mode("append").parquet(src)
        run.processAllAvailable()
    finally:
        run.stop()
    assert sorted((r.page_id, r.seq, r.src_text, r.tgt_text) for r in spark.table("pairs").collect()) == [("A", 2, "x", "y"), ("A", 3, "y", "w")]


def test_long_texts_reach_the_operators(spark, tmp_path):
    """Queries by brute force, over short texts and texts beyond all limits of the queries with SQL."""
    import random
    import re
    from collections import Counter

    from palimpsest.queries import QUERIES

    rnd = random.Random(3)
    some = lambda n: " ".join(rnd.choice(["The", "of", "and", "is", "er", "web", "stone", "river", "ñandú", "x1"]) for _ in range(n))
    docs = [(i, t, "en" if i % 3 else "de", "Web-River") for i, t in enumerate([None, "", "the", some(10), some(20), some(21), some(60), some(500), some(900), some(1500) + " rare"])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: sorted(tuple(r[c] for c in r.__fields__) for r in QUERIES[name](spark, str(tmp_path)).collect())
    toks = {i: re.findall(r"\w+", (t or "").lower()) for i, t, _, _ in docs}
    counts = Counter(w for v in toks.values() for w in set(v))
    controls, distances, windows = [], [], []
    for i, v in toks.items():
        shared = set(v) & {"web", "river", "the", "of", "and"}
        controls.append((i, min(shared or set(v), key=lambda w: (counts[w], w), default="n/a")))
        of = [k for k, w in enumerate(v) if w == "of"]
        distances += [(i, n, min((abs(k - e) for e in of), default=100_000_000)) for n, k in enumerate(k for k, w in enumerate(v) if w == "the")]
        hit = [w in ("the", "and", "is", "of", "er") for w in v]
        ends = [(sum(hit[e - 19 : e + 1]), e) for e in range(20, len(v))]
        tops = [e for n, e in ends if n == max(ends)[0]]
        windows.append((i, tops[len(tops) // 2] - 20, max(ends)[0]) if ends else (i, 0, len({w for w, h in zip(v, hit, strict=True) if h})))
    assert run("rarest_shared_token") == sorted(controls)
    assert run("url_token_distance") == sorted(distances)
    assert run("best_snippet_window") == [(0, 0, None)] + windows[1:]
    assert run("stop_token_difference") == sorted((i, w) for i, v in toks.items() if i % 3 for w in set(v) - set(text.STOP_WORDS["en"]))


def test_all_rows_reach_the_operators(spark, tmp_path):
    """Queries by brute force, over rows that the queries with SQL leave out too."""
    from collections import Counter
    from hashlib import md5

    from palimpsest.queries import QUERIES

    spark.createDataFrame([(i, f"text {i}") for i in range(25)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(o, n, float(1 + (o * 7 + n * 13) % 50), (o * 131 + n * 17) % 900, (o * 31 + n) % 400) for o in range(12) for n in range(1, 8)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: sorted(tuple(r[c] for c in r.__fields__) for r in QUERIES[name](spark, str(tmp_path)).collect())
    digest = lambda i: md5(f"text {i}".encode()).hexdigest()
    names = ("context", "grounding_true", "grounding_false", "target")
    got = sorted(tuple(r[c] for c in names) for r in QUERIES["counterfactual_explode"](spark, str(tmp_path)).collect())
    assert got == sorted(x for i in range(24) for x in ((i, digest(i), digest(i + 1), "t"), (i, digest(i + 1), digest(i), "n")))
    assert run("url_explode") == sorted(Counter(str(k) for r in items for k in (r[4], r[3])).items())
    want = []
    for o, n, quantity, supplier, part in items:
        g, c = int(quantity) * 20, supplier % 700
        while g + c + part % 150 > 1024:
            g, c = (g - 1, c) if g > c else (g, c - 1)
        want.append((o, n, g, c))
    assert run("trim_lengths") == sorted(want)


def test_languages_of_all_documents(spark, tmp_path):
    """Short, empty and null texts and rows of any lang have a row each; the clear cases their language."""
    from palimpsest.queries import QUERIES

    clear = [(i, " ".join(v[:40]), lang) for i, (lang, v) in enumerate(sorted(text.STOP_WORDS.items()))]
    rows = [*clear, (10, None, "en"), (11, "", None), (12, "the", "xx"), (13, "zzz 123", "de"), (14, "the stone and the river", None), (15, "der Stein und der Fluss " * 100, "??")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.lang for r in QUERIES["document_languages"](spark, str(tmp_path)).collect()}
    assert got == {i: lang for i, _, lang in clear} | {10: None, 11: None, 12: "en", 13: None, 14: "en", 15: "de"}


def test_all_comments_reach_the_operators(spark, tmp_path):
    """Queries by brute force, over comments of several lines, with entities and with empty tokens."""
    import re
    from hashlib import md5

    from palimpsest.queries import QUERIES

    texts = ["plain", "", "/* a */ b &amp; c &lt;d&gt;", "one\ntwo", "/* x */ first\nsecond", "a  b c   d e f g  h", "a\tb\nc d e f g h", "  a b c d e f g  ", "/* t */ Undid revision 5 of a b c d", "x &nbsp; y"]
    rows = [(c, turn, "user", x) for c, x in enumerate(texts) for turn in range(1, 5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    titles, checks = [], []
    for c, turn, role, x in rows:
        comment = f"/* {role} */ {x}" if turn % 2 == 0 else x
        m = re.search(r"^/\*(.+)\*/(.*)$", comment)
        rest = m.group(2).strip(" ") if m else comment
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\xa0"), ("&amp;", "&")) if m else ():
            rest = rest.replace(entity, char)
        titles.append((c, turn, m.group(1).strip(" ") if m else "", md5((rest.strip(" ") if m else rest).encode()).hexdigest()))
        bare = x.strip(" ")
        rejected = turn % 4 == 0 or turn % 4 > 2 or not bare.startswith("/*") or bare.endswith("*/") or bool(re.search("(?i)revert|undo|undid", bare))
        checks.append((c, turn, len(x.split()) >= 8 and "Undid revision" not in x, rejected))
    run = lambda name: sorted(tuple(r[c] for c in r.__fields__) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert run("section_title") == sorted(titles)
    assert run("comment_checks") == sorted(checks)


def test_queries_match_sql(spark):
    """Every query with SQL, over the smallest tables."""
    import os

    import duckdb

    from palimpsest.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    show = lambda v: "null" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    differ = []
    for name, run in QUERIES.items():
        df = run(spark, sf)
        got, names = df.collect(), sorted(df.columns)
        if name in ORACLE_SQL:
            want = con.sql(ORACLE_SQL[name])
            columns = want.columns
            at = [columns.index(c) for c in names]
            a = sorted(tuple(show(r[c]) for c in names) for r in got)
            b = sorted(tuple(show(row[i]) for i in at) for row in want.fetchall())
            if sorted(columns) != names or a != b:
                differ.append(name)
    assert not differ
    assert math.isfinite(len(QUERIES))


def test_revisions_in_small_splits(spark, tmp_path):
    """Splits that begin within pages know their page, and seq keeps the order."""
    rows = [(f"T{p}", p, r, 100 * p + r, 100 * p + r - 1, "t", "u", None, f"text {p} {r} " * (r % 5)) for p in range(30) for r in range(1, 25)]
    sinks.write_dump(spark.createDataFrame(rows, "page_title string, page_id int, seq int, rev_id int, parent_id int, timestamp string, username string, comment string, text string").coalesce(1), str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "5000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = dumps.read_revisions(spark, str(tmp_path / "d")).collect()
            assert sorted((r.page_title, int(r.page_id), int(r.rev_id), r.text) for r in got) == sorted((x[0], x[1], x[3], x[8]) for x in rows)
            of = {}
            for r in sorted(got, key=lambda r: (r.file, r.seq)):
                assert of.get(r.page_id, -1) < int(r.rev_id)
                of[r.page_id] = int(r.rev_id)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
