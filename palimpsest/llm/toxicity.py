"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give document scores and spans.

Labels are given per document, so token labels come from them: words and word beginnings that are significantly more
frequent in toxic documents are cues, and a token with a cue is toxic if its document is; all tokens of clean documents
are clean. The field (two states; weights of cues, transitions and a bias) is trained on stretches of tokens around cues and
on stretches without any. A document's score is a logistic function of its marginals, fitted on labelled documents that
the field wasn't trained on. Training takes a bounded sample: MAX_TOXIC and MAX_CLEAN labelled documents, least hash
first; scoring reads whole texts of all rows.

A token without a cue emits the same everywhere, so forward and backward messages cross a run of g such tokens as one
product with the g-th power of a 2 x 2 matrix: exact, and the work follows the tokens with cues.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import release, slices

MAX_TOXIC = 1500
MAX_CLEAN = 3000
PREFIXES = (4, 5, 6, 7, 8)
MAX_CUES = 5000
#: Tokens on either side of a cue that are tagged too, and that a training stretch has.
NEAR, AROUND = 2, 8
#: Powers beyond this one are equal in double precision once scaled.
FARTHEST = 2048
CACHE_WORDS = 200_000
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_TOKEN = re.compile(r"\w+")


def lowered(text: str) -> str:
    """text in lower case, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a following hyphen, which no word has)."""
    return [word, *[word[:k] + "-" for k in PREFIXES if len(word) > k]]


def find_cues(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features whose share of toxic documents is over that of clean ones by a factor of 4 and 3.5 standard errors."""
    seen = [Counter(), Counter()]
    for words, label in docs:
        seen[label].update({f for w in set(words) for f in features(w)})
    n = [sum(label == k for _, label in docs) for k in (0, 1)]
    found = []
    for f, pos in seen[1].items():
        if pos >= 3:
            neg = seen[0][f]
            gain = math.log((pos + 0.5) / (n[1] + 1)) - math.log((neg + 0.5) / (n[0] + 1))
            sure = gain / math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
            if gain >= math.log(4) and sure >= 3.5:
                found.append((-sure, f))
    return {f for _, f in sorted(found)[:MAX_CUES]}


class Crf:
    """Two states: 0 clean, 1 toxic. Emissions of state 0 are 0; all values are logarithms."""

    def __init__(self, weights: dict[str, float], bias: float, moves: np.ndarray, start: float, fit: list[float]):
        self.weights, self.bias, self.moves, self.start, self.fit = weights, bias, moves, start, fit
        step = np.exp(moves) * np.array([1.0, math.exp(bias)])
        power, self.powers = np.eye(2), [(1.0, 0.0, 0.0, 1.0)]
        for _ in range(FARTHEST):
            power = power @ step
            power /= power.sum()
            self.powers.append(tuple(power.ravel().tolist()))
        self.step = tuple(np.exp(moves).ravel().tolist())
        self.known: dict[str, float] = {}

    def emission(self, word: str) -> float:
        """The weight of the word's cues; 0.0 if it has none."""
        if (got := self.known.get(word)) is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            got = self.known[word] = sum([self.weights[f] for f in features(word) if f in self.weights])
        return got

    def marginals(self, words: list[str]) -> dict[int, float]:
        """The probability of state 1 for each token with a cue and those up to NEAR from one."""
        known = self.known
        values = [v if (v := known.get(w)) is not None else self.emission(w) for w in words]
        hits = [i for i, v in enumerate(values) if v]
        if not hits:
            return {}
        at = sorted({j for i in hits for j in range(max(0, i - NEAR), min(len(words), i + NEAR + 1))})
        a, b, c, d = self.step
        ahead, x, y, last = [], 1.0, math.exp(self.start), -1
        for k, i in enumerate(at):
            gap = i - last - 1
            if k or gap:
                if not k:  # the first token emits, then a run follows
                    y *= math.exp(self.bias)
                    gap -= 1
                p, q, r, s = self.powers[min(gap, FARTHEST)]
                x, y = x * p + y * r, x * q + y * s
                x, y = x * a + y * c, x * b + y * d
            y *= math.exp(min(50.0, self.bias + values[i]))
            x, y, last = x / (x + y), y / (x + y), i
            ahead.append((x, y))
        out, u, v, following = {}, 1.0, 1.0, len(words)
        for k in range(len(at) - 1, -1, -1):
            i = at[k]
            if (gap := following - i - 1) > 0:
                p, q, r, s = self.powers[min(gap, FARTHEST)]
                u, v = p * u + q * v, r * u + s * v
            x, y = ahead[k]
            out[i] = y * v / (x * u + y * v)
            v *= math.exp(min(50.0, self.bias + values[i]))
            u, v = a * u + b * v, c * u + d * v
            u, v, following = u / (u + v), v / (u + v), i
        return out

    def summary(self, words: list[str], found: dict[int, float]) -> list[float]:
        top = sorted(found.values(), reverse=True)[:2]
        logit = lambda p: math.log(max(p, 1e-6) / max(1 - p, 1e-6))
        first, second = [*top, 0.0, 0.0][:2]
        return [1.0, logit(first) / 5, logit(second) / 5, math.log1p(sum(found.values())), math.log1p(len(words)) / 5]

    def score(self, words: list[str], found: dict[int, float]) -> float:
        z = sum(a * b for a, b in zip(self.fit, self.summary(words, found), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _stretches(docs: list[tuple[list[str], int]], cues: set[str], index: dict[str, int]) -> list[tuple[list[list[int]], list[int], int]]:
    """(cue numbers of each token, token labels, document label) of up to 2 * AROUND + 1 tokens."""
    out = []
    for n, (words, label) in enumerate(docs):
        own = [[index[f] for f in features(w) if f in cues] for w in words]
        end = 0
        for i, x in enumerate(own):
            if x and i >= end:
                a, end = max(0, i - AROUND), min(len(words), i + AROUND + 1)
                out.append((own[a:end], [int(bool(y) and label == 1) for y in own[a:end]], label))
        if words and (a := (n * 7919) % len(words)) is not None and not any(own[a : a + 2 * AROUND + 1]):
            part = own[a : a + 2 * AROUND + 1]
            out.append((part, [0] * len(part), label))
    return out


def _train(stretches: list, n_cues: int, clean_weight: float, steps: int = 120, l2: float = 0.02) -> np.ndarray:
    """Parameters by Adam on the likelihood of the token labels: cue weights, bias, moves (4), start."""
    n, length = len(stretches), max(len(x[0]) for x in stretches)
    rows, cols, labels, mask = [], [], np.zeros((n, length), int), np.zeros((n, length), bool)
    for i, (own, tags, _) in enumerate(stretches):
        labels[i, : len(tags)], mask[i, : len(tags)] = tags, True
        for t, found in enumerate(own):
            rows += [i * length + t] * len(found)
            cols += found
    rows, cols = np.array(rows, int), np.array(cols, int)
    weight = np.array([1.0 if x[2] else clean_weight for x in stretches])
    weight /= weight.sum()
    theta, m, v = np.zeros(n_cues + 6), np.zeros(n_cues + 6), np.zeros(n_cues + 6)
    theta[n_cues] = -3.0
    pairs_seen = np.zeros(4)
    for a in (0, 1):
        for b in (0, 1):
            pairs_seen[2 * a + b] = (((labels[:, :-1] == a) & (labels[:, 1:] == b) & mask[:, 1:]) * weight[:, None]).sum()
    for step in range(1, steps + 1):
        emit = np.bincount(rows, theta[cols], n * length).reshape(n, length) + theta[n_cues] if len(rows) else np.full((n, length), theta[n_cues])
        moves, start = theta[n_cues + 1 : n_cues + 5].reshape(2, 2), theta[n_cues + 5]
        A = np.exp(moves)
        e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], -1)
        alpha = np.zeros((n, length, 2))
        alpha[:, 0] = e[:, 0] * np.array([1.0, math.exp(start)])
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            x = (alpha[:, t - 1] @ A) * e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], x / x.sum(1, keepdims=True), alpha[:, t - 1])
        beta = np.ones((n, length, 2))
        both = np.zeros(4)
        for t in range(length - 2, -1, -1):
            x = e[:, t + 1] * beta[:, t + 1]
            joint = alpha[:, t, :, None] * A[None] * x[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            both += (joint.reshape(n, 4) * (weight * mask[:, t + 1])[:, None]).sum(0)
            y = x @ A.T
            beta[:, t] = np.where(mask[:, t + 1, None], y / y.sum(1, keepdims=True), 1.0)
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        rest = (labels - gamma[:, :, 1]) * mask * weight[:, None]
        g = np.zeros_like(theta)
        if len(cols):
            g[:n_cues] = np.bincount(cols, rest.ravel()[rows], n_cues)
        g[n_cues] = rest.sum()
        g[n_cues + 1 : n_cues + 5] = pairs_seen - both
        g[n_cues + 5] = rest[:, 0].sum()
        g[:n_cues] -= l2 / n * theta[:n_cues]
        g[n_cues + 1 :] -= 1e-3 * theta[n_cues + 1 :]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (steps + 1))
    return theta


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps; the last column (length) and the others are shrunk, the first isn't."""
    beta, shrink = np.zeros(x.shape[1]), np.diag([1e-6, *[l2] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + shrink
        move = np.linalg.solve(hess, x.T @ (w * (y - p)) - shrink @ beta)
        beta += np.clip(move, -2, 2)
        if abs(move).max() < 1e-6:
            break
    return beta


def train(docs: list[tuple[str, int]], n_toxic: int, n_clean: int) -> Crf:
    """A model from sampled (text, label) rows, of n_toxic and n_clean labelled ones.

    Every third sampled document fits the scores, the others the cues and the field. Without documents of both labels,
    all scores are the smoothed share of toxic ones.
    """
    own = [(_TOKEN.findall(lowered(t)), y) for t, y in docs]
    sampled = [sum(y == k for _, y in own) for k in (0, 1)]
    share = [n_clean / max(1, sampled[0]), n_toxic / max(1, sampled[1])]
    if not min(sampled):
        z = math.log((n_toxic + 1) / (n_clean + 1))
        return Crf({}, -8.0, np.zeros((2, 2)), 0.0, [z, 0.0, 0.0, 0.0, 0.0])
    count, fitting, tagging = [0, 0], [], []
    for words, y in own:
        count[y] += 1
        (fitting if count[y] % 3 == 0 else tagging).append((words, y))
    cues = find_cues(tagging)
    names = sorted(cues)
    index = {f: i for i, f in enumerate(names)}
    theta = _train(_stretches(tagging, cues, index), len(names), share[0] / share[1])
    k = len(names)
    weights = {f: float(w) for f, w in zip(names, theta, strict=False) if abs(w) > 1e-3}
    crf = Crf(weights, float(theta[k]), theta[k + 1 : k + 5].reshape(2, 2), float(theta[k + 5]), [0.0] * 5)
    if {y for _, y in fitting} != {0, 1}:
        fitting = own
    x = np.array([crf.summary(words, crf.marginals(words)) for words, _ in fitting])
    y = np.array([label for _, label in fitting], float)
    w = np.array([share[label] / share[0] for _, label in fitting])
    crf.fit = _logistic(x, y, w).tolist()
    return crf


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Crf:
    """A model from labels (doc_id, toxic) of rows that aren't held out, and the texts of docs (doc_id, text).

    At most max_toxic and max_clean labelled documents, those whose doc_ids have the least hashes, come to the driver.
    Null labels and doc_ids count as not labelled; a doc_id labelled twice is toxic if either label says so. Of several texts
    with one doc_id, the least is learnt from.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = common.materialize(known)
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = lambda label, k: known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    chosen = least(1, max_toxic).unionByName(least(0, max_clean))
    texts = docs.select("doc_id", common.text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted((r.doc_id, r.text, r.toxic) for r in texts.collect())
    return train([(t, y) for _, t, y in rows], n.get(1, 0), n.get(0, 0))


def tag(df: DataFrame, model: Crf, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns in `keep` (default: all) with score (0 to 1), predicted (1 if score >= 0.5) and spans.

    spans: start and end (code points) of each run of tokens whose marginals are 0.5 or more. A null text counts as
    empty; an empty one gets the score of a text without tokens. Columns of df with the new names are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("score", "predicted", "spans")]
    own = common.free_name(df, "own_text")
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.moves, model.start, model.fit))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def runs(text: str, found: dict[int, float]) -> list[dict]:
        hot = sorted(i for i, p in found.items() if p >= 0.5)
        if not hot:
            return []
        places, out, last = [m.span() for m in _TOKEN.finditer(text)], [], -2
        for i in hot:
            if i == last + 1:
                out[-1]["end"] = places[i][1]
            else:
                out.append({"start": places[i][0], "end": places[i][1]})
            last = i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*sent.value)
        for whole in batches:
            for batch in slices(whole, own):
                scores, spans = [], []
                for x in batch.column(own).to_pylist():
                    low = lowered(x)
                    words = _TOKEN.findall(low)
                    found = crf.marginals(words)
                    scores.append(crf.score(words, found))
                    spans.append(runs(low, found))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, span_type)], names=[*keep, "score", "predicted", "spans"])
        del crf
        release()

    read = df.select(*keep, common.text_or_empty(text).alias(own))
    return common.to_python(read).mapInArrow(run, read.select(*keep).schema.add("score", "double").add("predicted", "integer").add("spans", _SPANS))


def keep_clean(df: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """The rows of df, with its columns, whose text isn't predicted to be toxic."""
    clash = {c: common.free_name(df, "own_" + c) for c in df.columns if c.lower() in ("score", "predicted", "spans")}
    back = {v: k for k, v in clash.items()}
    return tag(df.withColumnsRenamed(clash), model, clash.get(text, text)).filter("predicted = 0").drop("score", "predicted", "spans").withColumnsRenamed(back)


def labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, labels(spark, sf_dir))
    tagged = tag(docs, model, keep=["doc_id"])
    return tagged.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "spans")
