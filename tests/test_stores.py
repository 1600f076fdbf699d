"""Stores, templates, JSON maps, sized files, listings and resumed fetches, with the queries over them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.sources import stores

SF = "/root/testdata/sf0.001"
QUERIES = ["stored_pages", "template_files", "json_maps", "sized_files", "resumed_fetches", "sample_lines", "output_names", "crawl_listing"]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_match_sql(spark, name):
    import duckdb

    from palimpsest.operator_queries import ORACLE_SQL
    from palimpsest.operator_queries import QUERIES as every

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df, want = every[name](spark, SF), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    assert got == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_page_store_reads_few_folders(spark, tmp_path):
    rows = spark.range(500).select("id", F.concat(F.lit("t"), "id").alias("text"), F.lit(9).alias("bucket"))
    stores.write_page_store(rows, str(tmp_path / "s"), buckets=16)
    found = stores.find_pages(spark, str(tmp_path / "s"), [7, 7, None, 1000])
    assert [tuple(r) for r in found.collect()] == [(7, "t7")] and found.columns == ["id", "text"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan
    assert len({os.path.dirname(p) for p in found.inputFiles()}) == 16 and len(found.select(F.input_file_name()).distinct().collect()) == 1
    assert stores.find_pages(spark, str(tmp_path / "s"), []).count() == 0
    stores.write_page_store(rows.limit(0), str(tmp_path / "e"))


def test_templates_with_markup_and_nulls(spark, tmp_path):
    given = [("Template:A<b>", "10", "1", "x &lt; <y>\n&amp; </text>"), (None, "828", None, None), ("Page", "0", "2", "no")]
    stores.write_templates(spark.createDataFrame(given, "title string, ns string, id string, text string"), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in stores.read_templates(spark, str(tmp_path / "t")).collect()) == sorted([given[0], ("", "828", "", "")])


def test_json_maps(spark, tmp_path):
    given = {'a"]:["b': "]:[", "é\n": None, "": "x", "c": "{}"}
    df = spark.createDataFrame([*given.items(), (None, "gone")], "k string, v string").repartition(3)
    stores.write_json_map(df, "k", "v", str(tmp_path / "m"), files=2)
    found = {}
    for name in os.listdir(tmp_path / "m"):
        if name.endswith(".txt"):
            found |= json.load(open(tmp_path / "m" / name, encoding="utf-8"))
    assert found == given
    (tmp_path / "m" / "broken.txt").write_text("{")
    assert {r.key: r.value for r in stores.read_json_map(spark, str(tmp_path / "m"), "string").collect()} == given
    stores.write_json_map(df.limit(0), "k", "v", str(tmp_path / "e"))
    assert stores.read_json_map(spark, str(tmp_path / "e"), "string").count() == 0


def test_sized_files(spark, tmp_path):
    df = spark.createDataFrame([("x" * n,) for n in (1, 50, 2, 97, 3, 300, 4, 4)] + [(None,)], "v string").coalesce(1)
    stores.write_sized(df, str(tmp_path / "s"), F.col("v"), 100)
    sizes = [len(open(os.path.join(d, n), "rb").read()) for d, _, names in os.walk(tmp_path / "s") for n in names if n.endswith(".txt")]
    assert sorted(sizes) == [4, 11, 56, 98, 301]
    with pytest.raises(ValueError):
        stores.write_sized(df, str(tmp_path / "n"), F.col("v"), 0)


def test_fetches_go_on_where_they_ended(spark, tmp_path):
    """A fetcher that fails until a file is there: the second run has all, and asks only for what failed."""
    flag, path = str(tmp_path / "up"), str(tmp_path / "r")

    def get(row):
        if row["url"] == "late" and not os.path.exists(flag):
            raise OSError("down")
        return None if row["url"] == "empty" else {"html": row["url"] + str(os.path.exists(flag))}

    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("late", 1), ("empty", 1), (None, 1)], "url string, x int")
    shown = lambda df: sorted(tuple(r) for r in df.fillna("").collect())
    assert shown(stores.fetch_missing(wanted, path, get, rounds=2)) == [("a", "aFalse", "", 0), ("empty", "", "empty", 0), ("late", "", "OSError: down", 1)]
    open(flag, "w").close()
    assert shown(stores.fetch_missing(wanted, path, get)) == [("a", "aFalse", "", 0), ("empty", "", "empty", 0), ("late", "lateTrue", "", 2)]
    again = stores.fetch_missing(wanted, path, get, rounds=1, retry_empty=True)
    assert shown(again) == [("a", "aFalse", "", 0), ("empty", "", "empty", 3), ("late", "lateTrue", "", 2)]
    assert sorted(n for n in os.listdir(path) if n.startswith("round=")) == ["round=0", "round=1", "round=2", "round=3"]
    assert stores.fetch_missing(wanted.limit(0), str(tmp_path / "none"), get).count() == 0


def test_names_and_lines(spark):
    row = spark.range(1).select(text.output_name(F.lit("/a/" + "x" * 27 + "name.bz2")).alias("a"), text.output_name(F.lit("short")).alias("b"), text.sample_line(F.lit(1), F.lit(2), F.lit(None), [F.lit("t"), F.lit(None)], F.array(F.lit("w")), F.lit(None).cast("array<string>"), F.array().cast("array<int>"), F.array(F.lit(0), F.lit(2))).alias("c")).first()
    assert tuple(row) == ("name", "", "[1] 2/^t^^[1|0]^[]^[0,2]")


def test_listing_of_crawls(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "A", "name": "x"}, {"id": "B"}]')
    rows = stores.read_collections(spark, str(tmp_path / "c.json"), "p/{}/l.gz").collect()
    assert [tuple(r) for r in rows] == [(0, "A", "p/A/l.gz"), (1, "B", "p/B/l.gz")]
    lines = spark.createDataFrame([("a/cdx-1.gz ",), ("a/other.gz",), (None,)], "value string")
    assert [r.url for r in stores.index_urls(lines, "u/{}").collect()] == ["u/a/cdx-1.gz"]
