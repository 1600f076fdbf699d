"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source with ratio r = target / size goes in floor(r) times, and once more with probability
r - floor(r). Which documents those are is drawn by the cube method: in the flight phase, the probabilities of a few
documents at a time move along the null space of the balancing constraints (documents and words), until each but a few
is 0 or 1; the totals don't change on the way. Flights run in blocks of BLOCK_ROWS documents of a source; what each block
leaves (at most two documents) flies again with what FAN_IN other blocks left, level by level, until one block a source
remains. Landing rounds those last two; what that adds to or takes from the source's words is laid on its reserve, about
RESERVE of its smaller documents that haven't flown yet: their probabilities are raised or lowered together, and they fly
and land too. So the words taken miss the target by a small document at most. Last, documents of the reserve are taken, left
or exchanged for one another while that comes nearer to the target; up to there each draw is unbiased. Where the reserve can't
make up for a landing (a source that is mostly one document), the nearest landing is taken instead.
"""

import random
from bisect import bisect_left
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 2048
FAN_IN = 256
RESERVE = 512
#: Up to so many sources (a row each), targets are found on the driver and broadcast; beyond, by Spark.
LOCAL_SOURCES = 100_000
_EPS = 1e-9


def word_count(text: str = "text"):
    return F.regexp_count(common.text_or_empty(text), F.lit(f"[^{common.SPACE}]+")).cast("long")


def water_fill(sizes: list[int], weights: list[int], share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets: `share` of all sizes dealt by weight, none above `most` times its size, the excess dealt again."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ = sorted(set(open_) - set(full))
    return targets


def source_targets(sizes: DataFrame, local_sources: int = LOCAL_SOURCES) -> tuple[DataFrame, bool]:
    """(source, source_size, rows) with target; and whether the result is small enough to broadcast.

    Weights follow the order of the sources by code point, null last.
    """
    spark, n = sizes.sparkSession, sizes.count()
    schema = "source string, source_size long, rows long, target double"
    if n <= local_sources:
        found = sorted(sizes.collect(), key=lambda r: (r.source is None, r.source or ""))
        made = water_fill([r.source_size for r in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(n)])
        return spark.createDataFrame([(r.source, r.source_size, r.rows, t) for r, t in zip(found, made, strict=True)], schema), True
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    ranked = common.materialize(ordered.map(lambda x: (*x[0], WEIGHTS[x[1] % len(WEIGHTS)])).toDF("source string, source_size long, rows long, weight int"))
    cap = MOST * F.col("source_size")
    left = SHARE * ranked.agg(F.sum("source_size")).first()[0]
    unit, closed = 0.0, F.lit(False)
    while True:
        w = ranked.filter(~closed).agg(F.sum("weight")).first()[0]
        taken = ranked.filter(closed).agg(F.sum(cap)).first()[0] or 0.0
        if not w:
            break
        unit = (left - taken) / w
        before, closed = ranked.filter(closed).count(), closed | (F.lit(unit) * F.col("weight") > cap)
        if ranked.filter(closed).count() == before:
            break
    return ranked.select("source", "source_size", "rows", F.when(closed, cap).otherwise(F.lit(unit) * F.col("weight")).alias("target")), False


def null_vector(columns: list[tuple[float, ...]]) -> list[float]:
    """A nonzero vector that the matrix with these columns (more columns than rows) maps to zero."""
    n, rows = len(columns), [list(r) for r in zip(*columns, strict=True)]
    pivots: list[int] = []
    for row in range(len(rows)):
        best = max(((abs(rows[k][c]), k, c) for k in range(row, len(rows)) for c in range(n) if c not in pivots), default=(0, 0, 0))
        if best[0] < _EPS:
            break
        _, k, c = best
        rows[row], rows[k] = rows[k], rows[row]
        rows[row] = [x / rows[row][c] for x in rows[row]]
        for j in range(len(rows)):
            if j != row and rows[j][c]:
                rows[j] = [x - rows[j][c] * y for x, y in zip(rows[j], rows[row], strict=True)]
        pivots.append(c)
    free = next(c for c in range(n) if c not in pivots)
    out = [0.0] * n
    out[free] = 1.0
    for row, c in enumerate(pivots):
        out[c] = -rows[row][free]
    return out


def _move(p: list[float], live: list[int], u: list[float], draw: random.Random) -> None:
    """One step of p along u or -u, as far as a probability becomes 0 or 1; the direction is drawn so that p stays the mean."""
    reach = [min(((1 - p[i]) / (s * v) if s * v > 0 else p[i] / -(s * v)) for i, v in zip(live, u, strict=True) if abs(v) > _EPS) for s in (1, -1)]
    s, far = (1, reach[0]) if draw.random() * (reach[0] + reach[1]) < reach[1] else (-1, reach[1])
    for i, v in zip(live, u, strict=True):
        p[i] = min(1.0, max(0.0, p[i] + s * far * v))
        if p[i] < _EPS or p[i] > 1 - _EPS:
            p[i] = float(round(p[i]))


def cube_flight(p: list[float], x: list[tuple[float, ...]], draw: random.Random, landing: bool = False) -> list[float]:
    """p after the flight with balancing variables x (each a tuple of one length); with landing, all are 0 or 1.

    Landing drops the first variable, then the next, and so on; the last unit is rounded at random.
    """
    p, k = list(p), len(x[0]) if x else 0
    waiting, live = iter(range(len(p))), []
    for drop in range(k + 1 if landing else 1):
        rows = k - drop
        while True:
            live = [i for i in live if 0 < p[i] < 1]
            while len(live) <= rows and (i := next(waiting, None)) is not None:
                if 0 < p[i] < 1:
                    live.append(i)
            if len(live) <= rows:
                break
            _move(p, live, null_vector([x[i][drop:] for i in live]) if rows else [1.0] + [0.0] * (len(live) - 1), draw)
    return p


def _in_order(rows: pd.DataFrame, first: list[str]) -> pd.DataFrame:
    """rows in an order that doesn't depend on how they came, larger ones first."""
    rest = [c for c in rows.columns if c.startswith("keep_")]
    by = [*first, "size", "doc_id", "p", *rest]
    return rows.sort_values(by, ascending=[c != "size" for c in by], kind="stable").reset_index(drop=True)


def _fly(seed: int, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(rows, [])
        rows["p"] = cube_flight(rows["p"].tolist(), [(1.0, float(s)) for s in rows["size"]], random.Random(f"{seed}/{level}/{key}"))
        return rows

    return run


def _nearer(ends: list[float], size: list[int], free: range, lacks: float) -> list[float]:
    """ends with a few of the free ones taken, left, or exchanged for another, while that brings the words they lack nearer to 0."""
    ends = list(ends)
    while True:
        ins = sorted((size[i], i) for i in free if ends[i] == 0)
        outs = [(0, -1), *((size[i], i) for i in free if ends[i] == 1)]
        best, change = abs(lacks), None
        for gone, o in outs:
            at = bisect_left(ins, (lacks + gone, -1))
            for come, i in [(0, -1), *ins[max(0, at - 1) : at + 1]]:
                if abs(lacks + gone - come) < best - 0.5:
                    best, change = abs(lacks + gone - come), (o, i, come - gone)
        if change is None:
            return ends
        o, i, more = change
        lacks -= more
        if o >= 0:
            ends[o] = 0.0
        if i >= 0:
            ends[i] = 1.0


def _land(seed: int):
    """Of one source: what its flights left lands, then its reserve makes up for the words that took or gave."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(rows, ["reserve"])
        draw = random.Random(f"{seed}/landing/{key}")
        p, size, n = rows["p"].tolist(), rows["size"].tolist(), int((~rows["reserve"]).sum())
        x = [(1.0, float(s)) for s in size]
        lacks_of = lambda ends: sum(s * (a - b) for s, a, b in zip(size, p, ends, strict=False))
        less, more, held = -sum(s * q for s, q in zip(size[n:], p[n:], strict=True)), sum(s * (1 - q) for s, q in zip(size[n:], p[n:], strict=True)), sum(size[n:])
        beyond = lambda ends: max(0.0, less - lacks_of(ends), lacks_of(ends) - more)
        landed = cube_flight(p[:n], x[:n], draw, landing=True)
        if beyond(landed) > 0:  # more than the reserve can make up for: the nearest landing instead
            open_ = [i for i in range(n) if 0 < p[i] < 1]
            ends = [[float(bits[open_.index(i)]) if i in open_ else q for i, q in enumerate(p[:n])] for bits in product((0, 1), repeat=len(open_))]
            landed = min(ends, key=beyond)
        lacks = lacks_of(landed)
        raised = [min(1.0, max(0.0, q + lacks / held)) if held else q for q in p[n:]]
        ends = landed + cube_flight(raised, x[n:], draw, landing=True)
        rows["p"] = _nearer(ends, size, range(n, len(size)), lacks_of(ends))
        return rows

    return run


def balanced_sample(rows: DataFrame, seed: int = 0, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """rows (doc_id, source, size, p; rows and source_size of its source; any other columns) with p drawn to 0 or 1.

    Within each source, the sum of p (documents) and of p * size (words) stay near what they were. A draw depends on the
    seed, the source and its rows' doc_ids, sizes and p alone, so reruns agree. Repeated rows are drawn each by itself; a
    null source is a source; a null doc_id counts as any other.
    """
    spread = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "doc_id", "size"), F.lit(1 << 40))
    smaller = F.col("size") * F.col("rows") <= F.col("source_size")
    reserve = smaller & (spread(1) * F.col("rows") < RESERVE * (1 << 40))
    flying = rows.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("long")).withColumn("block", F.pmod(spread(2), F.col("blocks"))).withColumn("reserve", reserve)
    flying = common.materialize(flying)
    kept, flying, done, level = flying.filter("reserve"), flying.filter("NOT reserve"), [], 0
    while True:
        flown = common.materialize(flying.groupBy("source", "block").applyInPandas(_fly(seed, level), flying.schema))
        done.append(flown.filter((F.col("p") == 0) | (F.col("p") == 1)))
        left = flown.filter((F.col("p") > 0) & (F.col("p") < 1))
        if not left.filter("blocks > 1").limit(1).count():
            break
        flying = left.withColumn("blocks", F.ceil(F.col("blocks") / fan_in).cast("long")).withColumn("block", F.floor(F.col("block") / fan_in).cast("long"))
        level += 1
    out = left.unionByName(kept).groupBy("source").applyInPandas(_land(seed), left.schema)
    for part in done:
        out = out.unionByName(part)
    return out.drop("blocks", "block", "reserve")


def mix(rows: DataFrame, seed: int = 0, local_sources: int = LOCAL_SOURCES, keep: list[str] | None = None) -> DataFrame:
    """rows (doc_id, source, size) with source_size, target and copies (0, 1 or 2): how often the mix takes each.

    A null size counts as 0. A source without words has target 0 and is taken 0 times. An empty input gives an empty result.
    Repeated rows are drawn each by itself. Other columns of rows are left out, but for integers named in `keep`.
    """
    of_row = [F.col(c).cast("long").alias(f"keep_{i}") for i, c in enumerate(keep or [])]
    back = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep or [])]
    table = common.materialize(rows.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *of_row))
    sizes = common.materialize(table.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    targets, small = source_targets(sizes, local_sources)
    targets = targets.withColumnRenamed("source", "of_source")
    joined = table.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = joined.withColumn("base", F.floor(ratio + _EPS).cast("long")).withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0)))
    part = part.withColumn("p", F.when(F.col("p") < _EPS, 0.0).otherwise(F.col("p")))
    drawn = balanced_sample(part.filter("p > 0"), seed)
    return part.filter("p = 0").unionByName(drawn).select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("copies"), *back)


def _row_hashes(df: DataFrame) -> list:
    """Two 64-bit hashes of whole rows; maps, which have no order, go in as JSON."""
    values = [F.to_json(c.name) if "map<" in c.dataType.simpleString() else F.col(c.name) for c in df.schema]
    return [F.xxhash64(F.lit(k), *values) for k in range(2)]


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs mixed: each row as often as mix() takes it, with docs' columns (doc_id, source, text and any others).

    Rows are told apart by hashes of all their columns; rows that are equal in all are taken as often as mix() takes them
    together. A null text has no words, and is taken as a row of that size. An empty input gives an empty result.
    """
    size, x, y, n, m = (common.free_name(docs, f"own_{c}") for c in ("size", "x", "y", "copies", "rows"))
    keyed = docs.select("*", *[h.alias(c) for c, h in zip((x, y), _row_hashes(docs), strict=True)])
    drawn = mix(keyed.select("doc_id", "source", word_count().alias("size"), x, y), seed, keep=[x, y])
    counts = drawn.groupBy(x, y).agg(F.count(F.lit(1)).alias(m), F.sum("copies").alias(n)).filter(F.col(n) > 0)
    counts = common.materialize(counts)
    total = int(counts.agg(F.coalesce(F.sum(m), F.lit(0))).first()[0])
    taken = common.join_counted(keyed, counts, [x, y], m, total)
    if counts.filter(F.col(m) > 1).limit(1).count():
        equal = taken.filter(F.col(m) > 1).groupBy(x, y).agg(F.first(F.struct(*docs.columns)).alias(size), F.first(n).alias(n))
        taken = taken.filter(F.col(m) == 1).select(*docs.columns, n).unionByName(equal.select(f"{size}.*", n))
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    rows = common.documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size"))
    return mix(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
