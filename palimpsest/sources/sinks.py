"""Sinks: NDJSON, tab-separated and plain text, documents, merged and compressed output."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir, which the driver and all executors see; a temporary one if Spark is this one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="palimpsest-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_ndjson(df: DataFrame, path: str, compression: str = "none") -> None:
    """One object a line, nulls included, characters unescaped."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", compression).json(path)


def tsv_line(columns: Sequence[str]) -> Column:
    """The columns by tabs, null as '', unquoted."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    write_lines(df, path, tsv_line(columns or df.columns))


def write_lines(df: DataFrame, path: str, line: Column, compression: str = "none") -> None:
    df.select(line.alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_ordered(df: DataFrame, path: str, by: str, max_rows: int = 0) -> None:
    """NDJSON in the order of a column, with at most max_rows rows a file (0: no limit)."""
    df.orderBy(by).write.mode("overwrite").option("maxRecordsPerFile", max_rows).json(path)


def merge_files(df: DataFrame, path: str) -> None:
    """A single NDJSON file; for results that one task can write."""
    df.coalesce(1).write.mode("overwrite").json(path)


def document_line(base: str, as_json: bool = False, with_revision: bool = False) -> Column:
    """A document (id, revid, title, text) as a <doc> element whose first line is the title, or as JSON."""
    url = F.concat(F.lit(base + "?curid="), F.col("id"))
    if as_json:
        return F.to_json(F.struct("id", *(["revid"] if with_revision else []), url.alias("url"), "title", "text"))
    revision = F.concat(F.lit('" revid="'), F.col("revid")) if with_revision else F.lit("")
    return F.concat(F.lit('<doc id="'), F.col("id"), revision, F.lit('" url="'), url, F.lit('" title="'), F.col("title"), F.lit('">\n'), F.col("title"), F.lit("\n\n"), F.col("text"), F.lit("\n</doc>\n"))


def xml_escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def write_dump(revisions: DataFrame, path: str, compression: str = "none") -> None:
    """Revisions (page_title, page_id, rev_id, parent_id, timestamp, username, comment, text, and seq to order by) as XML dumps.

    A page's revisions are together and in order; whole pages lie in one file. Nulls are written as empty elements.
    """
    page = Window.partitionBy("page_id").orderBy("seq")
    element = lambda tag, c: F.concat(F.lit(f"<{tag}>"), F.coalesce(xml_escaped(F.col(c).cast("string")), F.lit("")), F.lit(f"</{tag}>"))
    head = F.when(F.row_number().over(page) == 1, F.concat(F.lit("<page>\n"), element("title", "page_title"), F.lit("<ns>0</ns>"), element("id", "page_id"), F.lit("\n"))).otherwise("")
    tail = F.when(F.lead("seq").over(page).isNull(), "\n</page>").otherwise("")
    inner = F.concat(element("id", "rev_id"), element("parentid", "parent_id"), element("timestamp", "timestamp"), F.lit("<contributor>"), element("username", "username"), F.lit("</contributor>"), element("comment", "comment"), element("text", "text"))
    rows = revisions.withColumn("own_line", F.concat(head, F.lit("<revision>"), inner, F.lit("</revision>"), tail))
    ordered = rows.repartition("page_id").sortWithinPartitions("page_id", "seq")

    def rooted(batches):
        line = lambda values: pa.RecordBatch.from_arrays([values], names=["value"])
        yield line(pa.array(["<mediawiki>"]))
        for batch in batches:
            yield line(batch.column("value"))
        yield line(pa.array(["</mediawiki>"]))

    ordered.select(F.col("own_line").alias("value")).mapInArrow(rooted, "value string").write.mode("overwrite").option("compression", compression).text(path)


def cstr_record() -> Column:
    """A record of several lines from (counter, context, target, groundings, control): see operators.grounding.control_tokens."""
    lines = F.transform("groundings", lambda g: F.concat(F.lit("<p>"), g))
    return F.concat_ws("\n", F.col("counter").cast("string"), "context", F.lower("target"), F.array_join(lines, "\n"), "control", F.lit(""))
