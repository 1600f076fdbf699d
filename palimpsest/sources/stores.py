"""Tables and files kept between runs: pages to be found by id, templates, JSON maps, files of bounded size, results of fetches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.sources.dumps import fetch_tried
from palimpsest.sources.sinks import xml_escaped


def _bucket(id_: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(id_.cast("string")), buckets.cast("long")).cast("int")


def write_page_store(pages: DataFrame, path: str, by: str = "id", buckets: int = 64) -> None:
    """Pages as a Parquet table that find_pages() reads a bucket of: folders by a hash of the id, rows sorted by it.

    The number of buckets is part of the folders' names. Columns called buckets or bucket are replaced.
    """
    placed = pages.withColumns({"buckets": F.lit(buckets), "bucket": _bucket(F.col(by), F.lit(buckets))})
    placed.repartition("buckets", "bucket").sortWithinPartitions("buckets", "bucket", by).write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path)


def find_pages(spark: SparkSession, path: str, ids: Sequence, by: str = "id") -> DataFrame:
    """The pages of a store with one of a few ids: only their buckets are read, and of those only row groups that may hold them.

    No ids give no rows, nor do null ones and ids that aren't there; repeated ids give their pages once.
    """
    store = spark.read.parquet(path)
    wanted = list(dict.fromkeys(i for i in ids if i is not None))
    if not wanted:
        return store.limit(0).drop("buckets", "bucket")
    places = [_bucket(F.lit(i).cast(store.schema[by].dataType), F.col("buckets")) for i in wanted]
    return store.filter(F.col("bucket").isin(*places) & F.col(by).isin(wanted)).drop("buckets", "bucket")


def template_block(title: str = "title", ns: str = "ns", id_: str = "id", text: str = "text") -> Column:
    """A page element with these four; nulls as empty elements, markup escaped."""
    element = lambda tag, c: F.concat(F.lit(f"<{tag}>"), F.coalesce(xml_escaped(F.col(c).cast("string")), F.lit("")), F.lit(f"</{tag}>"))
    return F.concat_ws("\n", F.lit("<page>"), element("title", title), element("ns", ns), element("id", id_), element("text", text), F.lit("</page>"))


def write_templates(pages: DataFrame, path: str, namespaces: Sequence[str] = ("10", "828"), compression: str = "none") -> None:
    """The pages (title, ns, id, text) of the template and module namespaces as page elements."""
    kept = pages.filter(F.col("ns").cast("string").isin(list(namespaces)))
    kept.select(template_block().alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """title, ns, id and text of the pages that write_templates() wrote; an empty element is ''."""
    raw = spark.read.option("lineSep", "</page>").text(path).filter(F.contains("value", F.lit("<page>")))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return raw.select(*[plain(F.regexp_extract("value", rf"(?s)<{t}>(.*?)</{t}>", 1)).alias(t) for t in ("title", "ns", "id", "text")])


#: A JSON map's file is read by one task, and as one string, which can't hold over 2 GB: files that would be larger become more.
MAP_FILE_BYTES = 64 << 20


def write_json_map(df: DataFrame, key: str, value: str, path: str, files: int | None = None, max_bytes: int = MAP_FILE_BYTES) -> None:
    """One JSON object a file, from key to value; `files` of them at most, or one a partition, while they keep to max_bytes.

    If all entries take more than that, they are dealt by their hash to as many files as it takes, of about max_bytes each (a
    longer entry is whole in its file). The entries' size is found by a pass before. Keys should be distinct, null ones are left out. A
    null value is null.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes is under 1")

    def shown(column: Column) -> Column:
        one = F.to_json(F.array(column), {"ignoreNullFields": "false"})  # strings and numbers have a JSON form in an array only
        return F.substring(one, F.lit(2), F.length(one) - 2)

    rows = df.filter(F.col(key).isNotNull()).select(F.concat(shown(F.col(key).cast("string")), F.lit(": "), shown(F.col(value))).alias("value"))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])
        yield lines(["{"])
        before = ""
        for batch in batches:
            for line in batch.column("value"):
                yield lines([before + line.as_py()])
                before = ","
        yield lines(["}"])

    parts = files or rows.rdd.getNumPartitions()
    size = rows.agg(F.sum(F.octet_length("value") + 2)).first()[0] or 0
    if size > parts * max_bytes:
        dealt = rows.repartition(-(-size // max_bytes), "value")
    else:
        dealt = rows if files is None else rows.coalesce(files)
    dealt.mapInArrow(wrapped, "value string").write.mode("overwrite").text(path)


def read_json_map(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """(key, value) of files that are one JSON object each; value: the type of the values. A file that isn't one gives no row."""
    kind = T.MapType(T.StringType(), T._parse_datatype_string(value))
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.map_entries(F.from_json("value", kind))).alias("e"))
    return raw.select(F.col("e.key").alias(key), F.col("e.value").alias("value"))


def write_sized(df: DataFrame, path: str, line: Column, max_bytes: int, compression: str = "none") -> None:
    """Lines in files of at most max_bytes each before compression, in the order that a task has them.

    A line that is longer than that has a file of its own. Files lie in folders part=/file=, numbered in their task.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes is under 1")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = 0, 0
        for batch in batches:
            numbers = []
            for n in batch.column("bytes").to_pylist():
                if held and held + n > max_bytes:
                    file, held = file + 1, 0
                held += n
                numbers.append(file)
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("part"), pa.array(numbers, pa.int64())], names=["value", "part", "file"])

    text = F.coalesce(line, F.lit(""))
    rows = df.select(text.alias("value"), F.spark_partition_id().alias("part"), (F.octet_length(text) + 1).alias("bytes"))
    placed = rows.mapInArrow(numbered, "value string, part int, file long")
    placed.write.mode("overwrite").option("compression", compression).partitionBy("part", "file").text(path)


def read_collections(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(pos, id, paths) from a listing of crawls, a JSON array of objects: pattern with each id in place of {}."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<id:string>>")))
    return raw.select("pos", F.col("col.id").alias("id"), F.replace(F.lit(pattern), F.lit("{}"), F.col("col.id")).alias("paths"))


def index_urls(lines: DataFrame, pattern: str, mark: str = "cdx", column: str = "value") -> DataFrame:
    """lines with url: pattern with the trimmed line in place of {}, of those lines that contain the mark."""
    kept = lines.filter(F.contains(F.col(column), F.lit(mark)))
    return kept.withColumn("url", F.replace(F.lit(pattern), F.lit("{}"), F.btrim(F.col(column), F.lit(" \t\r\n\x0b\x0c"))))


def _rounds(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("round", T.IntegerType())])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def fetch_missing(wanted: DataFrame, path: str, fetcher: Callable[[dict], dict | None], schema: str = "html string", key: str = "url", rounds: int = 3, retry_empty: bool = False) -> DataFrame:
    """Fetch those rows of wanted whose key has no result at path yet, round by round, and return the results.

    Each round appends a row for each key that it tried (see dumps.fetch_tried()) as a folder of path; so a run that ends
    early, or is run again, goes on with what is missing. A key is done once it was found, or came back empty, which
    retry_empty tries again; one that failed is tried in each round. The result has a row for each key tried, in this run
    or before: key, the columns of schema, error and round of its best try, found before empty before failed, then the latest.
    Null and repeated keys are left out.
    """
    spark, names = wanted.sparkSession, [f.split()[0] for f in schema.split(", ")]
    kind = T._parse_datatype_string(f"{schema}, error string")
    whole = T.StructType([T.StructField(key, wanted.schema[key].dataType), *kind.fields])
    own = wanted.filter(F.col(key).isNotNull()).dropDuplicates([key])
    for _ in range(rounds):
        done, left, last = _rounds(spark, path, whole), own, None
        if done is not None:
            had = F.col("error").isNull() if retry_empty else F.col("error").isNull() | (F.col("error") == "empty")
            left, last = own.join(done.filter(had).select(key).distinct(), key, "left_anti"), done.agg(F.max("round")).first()[0]
        if last is not None and not left.limit(1).count():
            break
        tried = fetch_tried(left, fetcher, schema, keep=[key]).select(key, *names, "error")
        tried.write.mode("overwrite").parquet(f"{path.rstrip('/')}/round={0 if last is None else last + 1}")
    rank = F.when(F.col("error").isNull(), 2).when(F.col("error") == "empty", 1).otherwise(0)
    found = _rounds(spark, path, whole)
    best = found.groupBy(key).agg(F.max_by(F.struct(*names, "error", "round"), F.struct(rank, "round")).alias("own"))
    return best.select(key, "own.*")
