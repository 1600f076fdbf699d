"""Sharding by balanced label propagation.

Documents are linked through hubs (here: equal texts). In each round, joins carry the bytes that each hub has in each
shard; a linked document then wants the shard that most of its neighbours' bytes are in, and moves if the draw allows
it: a shard takes in only what its capacity leaves, shared among those that want it. Once no one moves, what links
nothing fills the shards up to equal sizes, laid out along running sums. Rows in a hot group are joined by broadcast.
The driver gets counts a shard and a bucket only (at most LOCAL_SUMS numbers).
"""

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
ROUNDS = 6
#: Rows of a bucket, within which a window finds running sums; sums of buckets are added up on the driver up to so many.
BUCKET_ROWS = 1000
LOCAL_SUMS = 65_536
FAN_IN = 1024
#: A group with over 1/SPLIT of a shard moves document by document, a smaller one as a whole.
SPLIT = 8


def _draw(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _numbers(df: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table to broadcast, as a local relation: integers in all columns but the last, whose type follows its values."""
    last = pa.float64() if any(isinstance(r[-1], float) for r in rows) else pa.int64()
    kinds = [*[pa.int64()] * (len(names) - 1), last]
    return F.broadcast(df.sparkSession.createDataFrame(pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)))


def propagate(linked: DataFrame, loads: dict[int, int], capacity: float, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """linked (row, hub, size, hub_rows, hub_size, shard) after label propagation under capacity quotas.

    loads: the bytes that linked rows have in each shard. A row is linked to one hub here; the rows of a hub are
    neighbours of each other. Each round is written to the shared folder.
    """
    total = linked.count()
    for k in range(rounds):
        at = linked.groupBy("hub", "shard").agg(F.sum("size").alias("w"), F.max("hub_rows").alias("hub_rows"))
        wish = at.groupBy("hub").agg(F.max(F.struct("w", (-F.col("shard")).alias("s"))).alias("best"), F.max("hub_rows").alias("n")).select("hub", (-F.col("best.s")).cast("int").alias("want"), "n")
        wish = common.materialize(wish)
        joined = common.join_counted(linked, wish, ["hub"], "n", total).drop("n")
        flows = {(r.shard, r.want): r.w for r in joined.filter("want <> shard").groupBy("shard", "want").agg(F.sum("size").alias("w")).collect()}
        if not flows:
            return linked
        asked: dict[int, int] = defaultdict(int)
        for (_, to), w in flows.items():
            asked[to] += w
        odds = [(s, min(1.0, max(0.0, capacity - loads.get(s, 0)) / asked[s]) if asked[s] else 0.0) for s in range(shards)]
        if not any(p for _, p in odds):
            return linked
        unit = F.when(F.col("hub_size") > capacity / SPLIT, F.col("row")).otherwise(F.lit(-1))
        moved = joined.join(_numbers(linked, ["want", "odds"], odds), "want").withColumn("shard", F.when((F.col("want") != F.col("shard")) & (_draw(F.lit(k), "hub", unit) < F.col("odds")), F.col("want")).otherwise(F.col("shard")))
        linked = common.materialize(moved.select(*linked.columns))
        loads = {r.shard: r.w for r in linked.groupBy("shard").agg(F.sum("size").alias("w")).collect()}
    return linked


def _before(totals: DataFrame, by: list[str], local_sums: int) -> DataFrame:
    """totals (by, bucket, w) with before: the sum of w over the buckets before, each `by` for itself; small, if few rows are given.

    Up to local_sums rows are added up on the driver; more are first added up to fewer, in runs of FAN_IN buckets.
    """
    if totals.count() <= local_sums or not totals.filter("bucket > 0").limit(1).count():
        start, found = defaultdict(int), []
        for r in sorted(totals.collect(), key=lambda r: (*[r[c] for c in by], r.bucket)):
            key = tuple(r[c] for c in by)
            found.append((*key, r.bucket, start[key]))
            start[key] += r.w
        return _numbers(totals, [*by, "bucket", "before"], found or [(*[-1] * len(by), -1, 0)])
    runs = totals.withColumn("run", F.floor(F.col("bucket") / FAN_IN))
    upper = common.materialize(runs.groupBy(*by, F.col("run").alias("bucket")).agg(F.sum("w").alias("w")))
    inner = Window.partitionBy(*by, "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    joined = runs.withColumn("own", F.coalesce(F.sum("w").over(inner), F.lit(0))).join(_before(upper, by, local_sums).withColumnRenamed("bucket", "run"), [*by, "run"])
    return joined.select(*by, "bucket", (F.col("own") + F.col("before")).cast("long").alias("before"))


def _running(rows: DataFrame, by: list[str], value: Column, out: str, local_sums: int) -> DataFrame:
    """rows with the sum of value over the rows before, in the order of (bucket, h, doc_id, row), each `by` for itself."""
    totals = common.materialize(rows.groupBy(*by, "bucket").agg(F.sum(value).cast("long").alias("w")))
    inner = Window.partitionBy(*by, "bucket").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return summed.join(_before(totals, by, local_sums), [*by, "bucket"]).withColumn(out, F.col(out) + F.col("before")).drop("before")


def shard_by_bytes(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, bucket_rows: int = BUCKET_ROWS, local_sums: int = LOCAL_SUMS) -> DataFrame:
    """rows (doc_id, size, hub and any others) with shard int and slot long; the shards' sizes are near equal.

    Rows with one hub are linked and share a shard as far as capacity allows; a null hub links nothing. A null size counts
    as 0. doc_ids may be null or repeated; repeated rows each get a slot. Slots count from 0 in each shard. Columns called
    shard or slot are replaced, any others stay as they are. An empty input gives an empty result. Propagation ends when no
    row moves, when no shard has room for those that want it, or after `rounds` rounds; links that are cut then stay cut.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    own = [F.col("doc_id"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), F.col("hub"), F.struct(*names).alias("whole")]
    table = common.materialize(rows.select(*own, F.xxhash64("doc_id", "hub").alias("h"), F.monotonically_increasing_id().alias("row")))
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return table.select("whole.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    buckets = n // bucket_rows + 1
    table = table.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    capacity = total / shards
    groups = common.materialize(table.filter("hub IS NOT NULL").groupBy("hub").agg(F.count(F.lit(1)).alias("hub_rows"), F.sum("size").alias("hub_size")).filter("hub_rows > 1"))
    linked = common.materialize(common.join_counted(table.drop("whole"), groups, ["hub"], "hub_rows", n).withColumn("shard", F.pmod(F.xxhash64("h", "row"), F.lit(shards)).cast("int")))
    sizes = lambda df: {r.shard: r.w for r in df.groupBy("shard").agg(F.sum("size").alias("w")).collect()}
    slim = common.materialize(linked.select("row", "hub", "size", "hub_rows", "hub_size", "shard"))
    placed = propagate(slim, sizes(slim), capacity, shards, rounds)
    loads = sizes(placed)
    # A shard over its capacity gives back documents, to be laid out with those that link nothing.
    back = [(s, max(0.0, (w - capacity) / w) if w else 0.0) for s, w in loads.items()]
    placed = placed.join(_numbers(table, ["shard", "back"], back or [(0, 0.0)]), "shard").withColumn("stays", _draw(F.lit(-1), "row") >= F.col("back")).select("row", "shard", "stays")
    table = common.materialize(table.join(placed, "row", "left").withColumn("shard", F.when(F.col("stays"), F.col("shard"))).drop("stays"))
    loads = sizes(table.filter("shard IS NOT NULL"))
    free = table.filter("shard IS NULL").drop("shard")
    room = [max(0.0, capacity - loads.get(s, 0)) for s in range(shards)]
    scale = (total - sum(loads.values())) / (sum(room) or 1.0)
    ends = [sum(room[: s + 1]) * scale for s in range(shards - 1)]
    along = _running(free, [], F.col("size"), "at", local_sums)
    place = sum(((F.col("at") + F.col("size") / 2) >= e).cast("int") for e in ends) if ends else F.lit(0)
    laid = along.withColumn("shard", place.cast("int")).drop("at")
    # Rows were laid out along the buckets, so that a shard has whole ones: they are dealt anew to be numbered.
    anew = F.pmod(F.xxhash64(F.lit(1), "h", "row"), F.lit(buckets // shards + 1))
    whole = common.materialize(table.filter("shard IS NOT NULL").unionByName(laid).withColumn("bucket", anew))
    return _running(whole, ["shard"], F.lit(1).cast("long"), "slot", local_sums).select("whole.*", F.col("shard").cast("int").alias("shard"), "slot")


def op7_shards(spark, sf_dir: str) -> DataFrame:
    text = common.text_or_empty("text")
    rows = common.documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("hub"))
    return shard_by_bytes(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
