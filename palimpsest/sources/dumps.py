"""Sources: revision dumps, pages, NDJSON, crawl indexes, word lists, dump manifests.

All read by Spark's own readers, so any file system, compression and split that Spark knows works, and storage credentials
are the cluster's. Downloads aren't part of the engine: wanted_files() lists what is missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.schemas import CRAWL_META, SYNTHETIC_EXAMPLE

_PAGE = "title string, ns string, id string, redirect struct<_title:string>, revision array<struct<id:string,parentid:string,timestamp:string,contributor:struct<username:string,id:string,ip:string>,comment:string,text:string>>"


def between(text: Column, start: str, end: str) -> Column:
    """What lies between two literal marks, '' if either is missing (the end mark is looked for after the start)."""
    at = F.locate(start, text)
    rest = F.substring(text, at + len(start), F.length(text))
    stop = F.locate(end, rest)
    return F.when((at > 0) & (stop > 0), F.substring(rest, F.lit(1), stop - 1)).otherwise("")


def xml_text(block: Column, tag: str) -> Column:
    """The content of the first <tag ...> element of an XML block, still escaped; '' if there is none."""
    return F.regexp_extract(block, rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>", 1)


#: Rows of a split that seq can number, and splits and files whose pages may be broadcast.
SPLIT_ROWS = 1 << 24
BROADCAST_SPLITS = 100_000
_TITLE, _ID = (re.compile(rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>") for tag in ("title", "id"))
_FILLED = "value string, file string, block long, seq long, page_title string, page_id string"


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a split in order, each with the title and id of the last page that began in the split, and its number."""
    at, n, page = None, 0, (None, None)
    for batch in batches:
        rows = []
        for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block")), strict=True):
            if at != (file, block):
                at, n, page = (file, block), 0, (None, None)
            _, begins, head = value.rpartition("<page>")
            if begins:
                page = tuple(m[1] if (m := tag.search(head)) else "" for tag in (_TITLE, _ID))
            if n >= SPLIT_ROWS:
                raise ValueError(f"over {SPLIT_ROWS} revisions in one split of {file}: lower spark.sql.files.maxPartitionBytes")
            rows.append((block * SPLIT_ROWS + n, *page))
            n += 1
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("file"), batch.column("block"), *columns], names=["value", "file", "block", "seq", "page_title", "page_id"])


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """Revisions of XML dumps (plain, gz or bz2): REVISION's columns, and file and seq, which tell their order in the dump.

    Split at the end of each revision, so a page's history may spread over tasks, and each split is read in order by one
    task, without a shuffle. A split that begins within a page has its title and id from the last split that began one: a
    small table of splits. seq grows within a file, with gaps. Text stays XML-escaped. Missing fields are ''.
    """
    raw = spark.read.option("lineSep", "</revision>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    filled = raw.mapInArrow(_filled, _FILLED)
    last = filled.filter("page_id IS NOT NULL").groupBy("file", "block").agg(F.max_by(F.struct("page_title", "page_id"), "seq").alias("page"))
    every = raw.select("file", "block").distinct().join(last, ["file", "block"], "left")
    carried = every.withColumn("page", F.last("page", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    few = raw.rdd.getNumPartitions() + len(raw.inputFiles()) <= BROADCAST_SPLITS
    rows = filled.filter(F.contains("value", F.lit("<revision>"))).join(F.broadcast(carried) if few else carried, ["file", "block"], "left")
    rows = rows.withColumns({c: F.coalesce(c, f"page.{c}") for c in ("page_title", "page_id")}).withColumn("rev", F.substring_index("value", "<revision>", -1))
    contributor = xml_text(F.col("rev"), "contributor")
    outside = F.regexp_replace("rev", "(?s)<contributor.*?</contributor>", "")
    fields = {"rev_id": xml_text(outside, "id"), "parent_id": xml_text(outside, "parentid"), "timestamp": xml_text(outside, "timestamp"), "username": xml_text(contributor, "username"), "userid": xml_text(contributor, "id"), "userip": xml_text(contributor, "ip"), "comment": xml_text(outside, "comment"), "text": xml_text(outside, "text")}
    return rows.select("page_title", "page_id", *[c.alias(n) for n, c in fields.items()], "file", "seq")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a dump: id, revid, title, ns, redirect, categories and the text of the latest revision, unescaped.

    Of pages with one id, that with the greatest revision id stays; of equal ones, that with the greatest title and text.
    """
    rows = spark.read.format("xml").option("rowTag", "page").schema(_PAGE).load(path)
    last = F.element_at("revision", -1)
    text = F.coalesce(last["text"], F.lit(""))
    found = rows.select("id", last["id"].alias("revid"), "title", "ns", F.col("redirect._title").alias("redirect"), F.transform(F.regexp_extract_all(text, F.lit(r"\[\[Category:([^\]|]+)"), F.lit(1)), lambda c: F.trim(c)).alias("categories"), text.alias("text"))
    best = F.max_by(F.struct(*found.columns), F.struct(F.col("revid").try_cast("long"), "title", "text"))
    return found.groupBy("id").agg(best.alias("own")).select("own.*")


def page_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The raw text of each page element."""
    raw = spark.read.option("lineSep", "</page>").text(path)
    return raw.filter(F.contains("value", F.lit("<page>"))).select(F.concat(F.lit("<page>"), F.substring_index("value", "<page>", -1), F.lit("</page>")).alias("page"))


def site_info(spark: SparkSession, path: str) -> dict:
    """base, and namespaces by key, of a dump's head (one row)."""
    schema = "base string, namespaces struct<namespace:array<struct<_VALUE:string,_key:string>>>"
    row = spark.read.format("xml").option("rowTag", "siteinfo").schema(schema).load(path).first()
    if row is None:
        return {"base": "", "namespaces": {}}
    return {"base": (row.base or "").rpartition("/")[0], "namespaces": {n["_key"]: n["_VALUE"] or "" for n in (row.namespaces.namespace if row.namespaces else [])}}


def with_ids(pages: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Pages whose id is in the only column of ids."""
    return pages.join(ids.toDF(column).distinct(), column, "left_semi")


def read_ndjson(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """One object a line; files that have gone are left out."""
    return spark.read.option("ignoreMissingFiles", "true").schema(schema).json(paths)


def read_synthetic(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are objects of named examples: pos (from 0), name and the example's fields."""
    kind = T.MapType(T.StringType(), SYNTHETIC_EXAMPLE)
    rows = spark.read.text(path).select(F.posexplode(F.map_entries(F.from_json("value", kind))))
    return rows.select("pos", F.col("col.key").alias("name"), "col.value.*")


def dump_files(spark: SparkSession, path: str, start: int = 1, end: int | None = None, kind: str = "metahistorybz2dump") -> DataFrame:
    """(idx, file, url, md5) of a dump's status file, by name; idx from 1, and only start to end."""
    entry = "struct<url:string,md5:string>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<jobs:map<string,struct<files:map<string,{entry}>>>>").alias("v"))
    rows = raw.select(F.explode(F.map_entries(F.element_at("v.jobs", kind)["files"])).alias("e")).select(F.col("e.key").alias("file"), "e.value.*")
    return numbered(rows, "file", start, end)


def numbered(rows: DataFrame, by: str, start: int = 1, end: int | None = None) -> DataFrame:
    """rows with idx from 1 in the order of `by`, and only those from start to end.

    With an end, each task keeps its first rows up to it before they meet. For lists of files, not for data.
    """
    few = rows if end is None else rows.orderBy(by).limit(end)
    return few.withColumn("idx", F.row_number().over(Window.orderBy(by))).filter(F.col("idx") >= start)


def wanted_files(manifest: DataFrame, present: DataFrame, by: str = "file") -> DataFrame:
    """Files of the manifest that aren't there yet."""
    return manifest.join(present.select(by).distinct(), by, "left_anti")


def verify_md5(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (file, md5) with status: pass, crash (other content) or miss; files: file and content (binary)."""
    own = files.select("file", F.md5("content").alias("found"))
    status = F.when(F.col("found").isNull(), "miss").when(F.col("found") == F.lower("md5"), "pass").otherwise("crash")
    return manifest.join(own, "file", "left").withColumn("status", status).drop("found")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read_cdx(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(surt, timestamp, url, value) of crawl index lines: key, time and a JSON object, parted by spaces."""
    line = F.split("value", " ", 3)
    return spark.read.text(paths).select(F.get(line, 0).alias("surt"), F.get(line, 1).alias("timestamp"), F.get_json_object(F.get(line, 2), "$.url").alias("url"), "value")


def read_prejoined(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, metas) from lines of a canonical URL, a field and a JSON object, parted by tabs; bad lines are left out."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(parts) == 3).select(F.get(parts, 0).alias("canonical"), F.from_json(F.get(parts, 2), CRAWL_META).alias("meta"))
    return rows.filter(F.col("meta.filename").isNotNull()).groupBy("canonical").agg(F.collect_list("meta").alias("metas"))


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A list with one entry a line: trimmed, without blank lines and repeats, in order. For lists that fit on the driver."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).filter("w <> ''").distinct().orderBy("w")
    return [r.w for r in rows.collect()]


def read_unigrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema("word string, count long").csv(path)


def merge_results(main: DataFrame, backup: DataFrame, key: str = "url") -> DataFrame:
    """Rows of main, and those of backup whose key main doesn't have."""
    return main.unionByName(backup.join(main.select(key).distinct(), key, "left_anti"))


def split_response(record: Column) -> Column:
    """Struct of warc, http and body of a crawl record; null unless its status line has 200 OK."""
    parts = F.split(record, "\r\n\r\n", 3)
    return F.when((F.size(parts) == 3) & F.contains(F.get(parts, 1), F.lit("200 OK")), F.struct(F.get(parts, 0).alias("warc"), F.get(parts, 1).alias("http"), F.get(parts, 2).alias("body")))


def fetch_tried(metas: DataFrame, fetcher, schema: str = "url string, html string", keep: Sequence[str] = ()) -> DataFrame:
    """A row for each meta, by fetcher(dict) -> dict or None in the tasks: its columns `keep`, the page's columns, and error.

    A page that can't be had is a page less: its columns are null, and error says why ('empty' where the fetcher gave none).
    """
    names, keep = [f.split()[0] for f in schema.split(", ")], list(keep)
    kept = "".join(f"`{c}` {metas.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        import pandas as pd

        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                try:
                    got, error = fetcher(row), "empty"
                except Exception as e:  # noqa: BLE001  counted by fetch_counts()
                    got, error = None, f"{type(e).__name__}: {e}"
                own = [row[c] for c in keep]
                found.append((*own, *[got.get(n) for n in names], None) if got else (*own, *[None] * len(names), error))
            yield pd.DataFrame(found, columns=[*keep, *names, "error"])

    return metas.mapInPandas(run, f"{kept}{schema}, error string")


def fetch(metas: DataFrame, fetcher, schema: str = "url string, html string") -> DataFrame:
    """Pages for crawl metas by fetcher(dict) -> dict or None, in the tasks; rows that fail are left out (see fetch_tried())."""
    return fetch_tried(metas, fetcher, schema).filter("error IS NULL").drop("error")


def fetch_counts(tried: DataFrame) -> DataFrame:
    """One row: tried, found, empty and failed of fetch_tried()."""
    none, empty = F.col("error").isNull(), F.col("error") == "empty"
    return tried.agg(F.count(F.lit(1)).alias("tried"), F.count_if(none).alias("found"), F.count_if(empty).alias("empty"), F.count_if(~none & ~empty).alias("failed"))
