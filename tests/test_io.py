"""Readers, writers, corpus plans, templates and streams, by round trips."""

import bz2
import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text, wikitext
from palimpsest.operators import edits
from palimpsest.plans import corpus
from palimpsest.sources import dumps, sinks
from palimpsest.streaming import revisions


def files(path, end):
    return sorted(f"{path}/{n}" for n in os.listdir(path) if n.endswith(end) and not n.startswith(("_", ".")))


def test_ndjson_in_order_merged_and_missing(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("é<"), "id").alias("t"), F.lit(None).cast("string").alias("none")).repartition(4)
    sinks.write_ndjson(df, str(tmp_path / "a"))
    lines = [json.loads(x) for p in files(tmp_path / "a", ".json") for x in open(p, encoding="utf-8")]
    assert sorted(x["id"] for x in lines) == list(range(100)) and lines[0].keys() == {"id", "t", "none"}
    assert "é<" in open(files(tmp_path / "a", ".json")[0], encoding="utf-8").read()
    sinks.write_ordered(df, str(tmp_path / "o"), "id", max_rows=7)
    found = [json.loads(x)["id"] for p in files(tmp_path / "o", ".json") for x in open(p, encoding="utf-8")]
    assert found == list(range(100)) and all(sum(1 for _ in open(p, encoding="utf-8")) <= 7 for p in files(tmp_path / "o", ".json"))
    sinks.merge_files(df, str(tmp_path / "m"))
    assert len(files(tmp_path / "m", ".json")) == 1
    back = dumps.read_ndjson(spark, [str(tmp_path / "a"), str(tmp_path / "m")], "id long, t string")
    assert back.count() == 200 and back.distinct().count() == 100


def test_binary_files_and_unigrams(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bin").write_bytes(b"\x00\x01")
    assert [(r.file, bytes(r.content)) for r in dumps.read_binary(spark, str(tmp_path / "b")).collect()] == [("x.bin", b"\x00\x01")]
    (tmp_path / "u.csv").write_text("word,count\nthe,10\nrare,1\n")
    assert sorted(map(tuple, dumps.read_unigrams(spark, str(tmp_path / "u.csv")).collect())) == [("rare", 1), ("the", 10)]


def test_sample_pages_are_whole_and_compressed(spark, tmp_path):
    pages = spark.range(200).select(F.concat(F.lit("<page><id>"), "id", F.lit("</id></page>")).alias("page"))
    corpus.sample_pages(pages, 0.2, str(tmp_path / "s"))
    lines = [x for p in files(tmp_path / "s", ".bz2") for x in bz2.open(p, "rt").read().splitlines()]
    assert 15 < len(lines) < 70 and set(lines) <= {r.page for r in pages.collect()}


def test_sample_corpus_steps(spark):
    rows = [(str(i), [["w"] * 2] * (8 + i), [0] * (i % 3), ["x"] * 9, [4]) for i in range(12)]
    df = spark.createDataFrame(rows, "rev_id string, tgt_sents array<array<string>>, tgt_sent_diff array<int>, tgt_tokens array<string>, tgt_token_diff array<int>").withColumns({"src_tokens": F.col("tgt_tokens"), "src_token_diff": F.col("tgt_token_diff")})
    kept = corpus.shuffled_corpus(df, seed=3)
    assert {r.rev_id for r in kept.collect()} == {str(i) for i in range(12) if 8 + i - i % 3 >= 10}
    assert [r.rev_id for r in kept.collect()] != sorted(r.rev_id for r in kept.collect())
    cut = corpus.recontext(df, 2).collect()
    assert all(r.tgt_tokens == ["x"] * 5 and r.tgt_action == [0, 0, 1, 0, 0] for r in cut)
    comments = spark.createDataFrame([("3", "c3"), ("5", "c5"), ("99", "no")], "rev_id string, comment string")
    assert sorted((r.rev_id, r.comment) for r in corpus.with_comments(df, comments).collect()) == [("3", "c3"), ("5", "c5")]


def test_templates_of_pages(spark):
    pages = spark.createDataFrame([("Template:Hi", "10", "Hello {{{1|you}}}<noinclude>doc</noinclude>"), ("Template:Hey", "10", "#REDIRECT [[Template:Hi]]"), ("Article", "0", "{{Hi}}"), ("Template:Hi", "10", "A")], "title string, ns string, text string")
    templates = wikitext.load_templates(pages)
    assert set(templates[0]) == {"Template:Hi"} and set(templates[1]) == {"Template:Hey"}
    assert wikitext.to_lines("{{Hey|Bob}} and {{hi}}", templates=templates[0], redirects=templates[1]) == ["Hello Bob and Hello you"]
    with pytest.raises(ValueError):
        wikitext.load_templates(pages, max_bytes=3)


def test_sentence_helpers(spark):
    df = spark.createDataFrame([("One is. Two is! Three is? Four.",), ("a [b\n] c\nd e\n;\nf",), ("",)], "t string")
    got = [tuple(r) for r in df.select(text.last_sentences(F.col("t"), 2), text.clean_sentence(F.col("t"))).collect()]
    assert got[0][0] == "Three is? Four." and got[1][1] == "a b c d e f" and got[2] == ("", "")


def test_split_edits_of_sections(spark):
    src = "Lead is the same here.\n== One ==\nThe old river runs to the sea. It is a very long one.<ref>r</ref>\n== Gone ==\nx"
    tgt = "Lead is the same here.\n== One ==\nThe old river runs to the wide sea. It is a very long one.\n== New ==\ny"
    rows = edits.split_edits(cutoff=0.3)(spark.createDataFrame([(src, tgt)], "src_text string, tgt_text string")).collect()
    assert [(r.section_title, r.source.tokens, r.target.tokens) for r in rows] == [("One", "The old river runs to the sea .".split(), "The old river runs to the wide sea .".split())]
    assert rows[0].source.numbers == [0] and rows[0].target.right_context == ["It is a very long one .".split()]


def run_stream(spark, tmp_path, schema, batches, make, mode):
    src = str(tmp_path / "in")
    spark.createDataFrame(batches[0], schema).coalesce(1).write.parquet(src)
    query = make(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("out_" + tmp_path.name.replace("-", "_")).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        for rows in batches[1:]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            query.processAllAvailable()
        return spark.table(query.name).collect()
    finally:
        query.stop()


def stamp(day, hour=0):
    import datetime

    return datetime.datetime(2024, 1, day, hour)


def test_new_urls_and_progress(spark, tmp_path):
    batches = [[("a", stamp(1), None), ("b", stamp(1), "gone")], [("a", stamp(1, 5), None), ("b", stamp(1, 6), None), ("c", stamp(1, 7), "empty")]]
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    (tmp_path / "z").mkdir()
    schema = "url string, ts timestamp, error string"
    assert sorted(r.url for r in run_stream(spark, tmp_path / "x", schema, batches, revisions.new_urls, "append")) == ["a", "b", "c"]
    assert sorted(r.url for r in run_stream(spark, tmp_path / "y", schema, batches, revisions.fetch_progress, "append")) == ["a", "b"]
    assert {r.outcome: r.n for r in run_stream(spark, tmp_path / "z", schema, batches, revisions.outcome_counts, "complete")} == {"found": 3, "failed": 1, "empty": 1}


def test_windowed_counts(spark, tmp_path):
    rows = [("view", stamp(1, 1)), ("view", stamp(1, 1)), ("buy", stamp(1, 2))]
    got = run_stream(spark, tmp_path, "event_type string, ts timestamp", [rows], revisions.windowed_counts, "complete")
    assert sorted((r.event_type, r.n) for r in got) == [("buy", 1), ("view", 2)]
