"""The opN queries against brute force over whole small tables, the pipeline's stages, and near-dedup's recall."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from palimpsest.llm import bpe, common, fingerprints, licenses, mixing, near_dedup, packing, toxicity
from palimpsest.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF).orderBy("doc_id").collect()


def run(spark, name, sf=SF):
    full = next(n for n in QUERIES if n.startswith(name + "_"))
    return QUERIES[full](spark, sf).collect()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_mix_query(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op2")}
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    of = {d.doc_id: d.source for d in docs}
    sums = Counter()
    for i, s in of.items():
        sums[s] += size[i]
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    # Pour the whole in small parts, each shared by weight among sources that aren't full: a filling by steps, not by formula.
    level, left, part = dict.fromkeys(names, 0.0), 1.5 * sum(sums.values()), 1.5 * sum(sums.values()) / 20_000
    while left > 1e-6:
        open_ = [s for s in names if level[s] < 2 * sums[s] - 1e-9]
        pour = min(left, part)
        for s in open_:
            level[s] += min(pour * weight[s] / sum(weight[x] for x in open_), 2 * sums[s] - level[s])
        left = 1.5 * sum(sums.values()) - sum(level.values())
    taken = Counter()
    for i, r in got.items():
        assert r["size"] == size[i] and r.source_size == sums[of[i]] and r.taken in (0, size[i], 2 * size[i])
        assert abs(r.target - level[of[i]]) <= 0.002 * level[of[i]] + 1
        taken[of[i]] += r.taken
    assert len(got) == len(docs)
    for s in names:
        assert abs(taken[s] - level[s]) <= max(0.02 * level[s], sorted(size[i] for i in of if of[i] == s)[len([i for i in of if of[i] == s]) // 2] + 1)
    assert sorted(map(str, run(spark, "op2"))) == sorted(map(str, got.values()))


def paragraphs(text):
    head, tail = text[: fingerprints.HEAD], text[fingerprints.HEAD :]
    return {p for p in re.findall(fingerprints._FINE, head) + re.findall(fingerprints._COARSE, tail) if p != "\n"}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprint_query(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op6")}
    assert len(got) == len(docs)
    prints = defaultdict(set)
    for k, d in enumerate(docs):
        text, after, r = d.text or "", docs[(k + 1) % len(docs)].text or "", got[d.doc_id]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert (r.n_chars, r.edited_sha256) == (len(text), digest(edited))
        assert r.near_edited == pytest.approx(jaccard(paragraphs(text), paragraphs(edited)))
        assert r.near_next == pytest.approx(jaccard(paragraphs(text), paragraphs(after)))
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len({next(iter(v)) for v in prints.values()}) == len(prints)


def test_fingerprints_as_text_can_be_peeled(spark):
    rnd = random.Random(1)
    some = [f"sentence {i} of {rnd.random()}." for i in range(5)]
    df = spark.createDataFrame([("\n".join(some), "\n".join(some[:4] + ["another one."]))], "a string, b string")
    df = fingerprints.fingerprint(fingerprints.fingerprint(df, "a", "fa"), "b", "fb")
    cells = fingerprints.subtract(fingerprints.read_sketch(F.col("fa")), fingerprints.read_sketch(F.col("fb")))
    d = df.select(fingerprints.peel(cells, F.lit(24)).alias("d"), fingerprints.digests(F.col("a")).alias("x"), fingerprints.digests(F.col("b")).alias("y")).first()
    assert set(d.d.plus) == set(d.x) - set(d.y) and set(d.d.minus) == set(d.y) - set(d.x) and d.d.plus


def test_shard_query(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op7")}
    loads, slots, largest = Counter(), defaultdict(list), 0
    for d in docs:
        r, data = got[d.doc_id], (d.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        largest = max(largest, r["size"])
    assert set(loads) <= set(range(16)) and max(loads.values()) - sum(loads.values()) / 16 <= largest
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_pack_query(spark, docs):
    packed = QUERIES["op9_pack_tokens"](spark, SF)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    pieces = defaultdict(list)
    for r in packing.unpack(packed).collect():
        pieces[r.doc_id].append((r.piece, r.ids))
    assert {d.doc_id: sum((x for _, x in sorted(pieces[d.doc_id])), []) for d in docs} == {d.doc_id: encoding.encode_ordinary(d.text or "") for d in docs}
    rows = packed.collect()
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(places) == packing.SEQ_LEN and r.cu_seqlens[-1] == r.n_tokens and r.n_segments == len(r.doc_ids)
        assert all(places[a:e].tolist() == list(range(e - a)) for a, e in zip(r.cu_seqlens, r.cu_seqlens[1:]))
    assert len(rows) <= -(-sum(r.n_tokens for r in rows) // packing.SEQ_LEN) * 1.1 + 1


def test_packing_of_a_text_in_several_pieces(spark):
    text = "some words " * 110_000
    rows = spark.createDataFrame([(None, text, "en", "s", 1), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1)], SCHEMA)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    found = sorted((r.piece, len(r.ids), r.ids) for r in packing.unpack(packing.pack(rows, block_bytes=100_000)).collect())
    whole = encoding.encode_ordinary(text)
    assert [x for _, n, ids in found if n > 1 for x in ids] == whole and sum(n == 1 and ids == encoding.encode_ordinary("x") for _, n, ids in found) == 2


def test_toxicity_query(spark):
    sf = SF.replace("0.001", "0.01")
    texts = {r.doc_id: r.text or "" for r in common.documents(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in toxicity.labels(spark, sf).collect()}
    got = {r.doc_id: r for r in run(spark, "op10", sf)}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert all(0 <= s.start < s.end <= len(texts[i]) for s in r.spans)
    held = [i for i in labels if got[i].held_out]
    assert sum(got[i].predicted == labels[i] for i in held) / len(held) > 0.9
    assert all(got[i].spans for i in got if got[i].predicted)


def test_toxicity_of_repeated_ids_and_ties(spark):
    rows = [(i % 30, f"text {i} " + ("zarkig" if i % 30 < 10 else "calm"), "en", "s", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, 0, int(i < 10)) for i in range(30)] * 2, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, SCHEMA)
    scores = [sorted(map(str, toxicity.tag(df, toxicity.fit(x, labels), keep=["doc_id"]).collect())) for x in (df, df.repartition(7))]
    assert scores[0] == scores[1] and len(scores[0]) == 60


def test_license_scan_of_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "en", "s", 1)] * 3 + [(None, None, "en", "s", 0)], SCHEMA)
    got = licenses.scan(df).collect()
    assert sorted(len(r.matches) for r in got) == [0, 1, 1, 1] and licenses.scan(df.limit(0)).count() == 0


def test_whole_licences_from_files(spark, tmp_path):
    rnd = random.Random(4)
    whole = lambda k: "\n\n".join(" ".join(f"{rnd.choice(['grant', 'notice', 'you', 'work', 'terms'])}{rnd.randint(0, k)}" for _ in range(90)) for _ in range(12))
    texts = {"Long-1.0": whole(60), "Long-2.0": whole(90)}
    for name, t in texts.items():
        (tmp_path / f"{name}.txt").write_text(t)
    own = licenses.read_templates(spark, str(tmp_path))
    assert [n for n, _ in own] == sorted(texts)
    changed = texts["Long-2.0"].replace("grant1", "permit1")
    rows = [(1, f"before it\n\n{texts['Long-1.0']}\n\nafter it", "en", "s", 1), (2, changed, "en", "s", 1), (3, texts["Long-1.0"][: len(texts["Long-1.0"]) // 2], "en", "s", 1)]
    got = {r.doc_id: [m.license for m in r.matches] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA), templates=own).collect()}
    assert got == {1: ["Long-1.0"], 2: ["Long-2.0"], 3: []}
    with pytest.raises(ValueError):
        licenses.read_templates(spark, str(tmp_path), most_bytes=100)


def test_fingerprints_of_empty_long_and_clashing_rows(spark):
    long = "\n".join(f"line {i} has its own words, {i * 7}." for i in range(20_000))
    df = spark.createDataFrame([(long, long + "\nx"), ("", None), ("same", "same"), ("same", "same")], "a string, b string").withColumns({c: F.lit(c) for c in ("own_a", "own_b", "changed", "fingerprint")})
    got = fingerprints.compare(df, "a", "b").collect()
    likes = sorted(r.changed.likeness for r in got)
    assert len(got) == 4 and 0.999 < likes[0] < 1 and likes[1:] == [1.0] * 3 and got[0].own_a == "own_a"
    assert fingerprints.compare(df.limit(0), "a", "b").count() == 0 and fingerprints.fingerprint(df.limit(0), "a").count() == 0
    clash = spark.createDataFrame([(i, f"t{i}") for i in range(30)] + [(None, "n")] * 3, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("own_range", "own_copy", "own_id", "own_hash")})
    after = fingerprints.with_next(clash, "doc_id", "text", "next", range_rows=4).collect()
    assert len(after) == 33 and all(r.own_hash == "own_hash" for r in after)
    assert {r.doc_id: r.next for r in after if r.doc_id is not None} == {i: f"t{i + 1}" if i < 29 else "n" for i in range(30)}


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    table = common.documents(spark, SF)
    model = toxicity.fit(table, toxicity.labels(spark, SF))
    want = {r.doc_id for r in toxicity.tag(table, model, keep=["doc_id"]).collect() if not r.predicted}
    assert {r.doc_id for r in stages["toxicity"](spark, table, SF).collect()} == want
    mixed = stages["mix sources"](spark, table, SF).collect()
    copies = {r.doc_id: r.copies for r in mixing.mix(table.select("doc_id", "source", mixing.word_count().alias("size"))).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in copies.items() if n})
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    for r in stages["byte-level BPE"](spark, table, SF).collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(r.text or ""))
    odd = table.withColumn("row", F.lit("clash")).limit(5).unionByName(table.withColumn("row", F.lit("clash")).limit(5)).unionByName(table.withColumn("row", F.lit("clash")).limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES:
        made, none = stage(spark, odd, SF), stage(spark, odd.limit(0), SF)
        assert none.count() == 0 and made.count() >= 0
        if name != "byte-level BPE":
            assert made.columns == odd.columns


def linked_pairs(texts, threshold=0.8, words=5):
    """All pairs of texts whose shingle sets are alike, by an inverted index."""
    sets = []
    for t in texts:
        w = near_dedup.words_of(t).split(" ")
        sets.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    index, numbered = defaultdict(list), {}
    for k, s in enumerate(sets):
        for x in s:
            index[numbered.setdefault(x, len(numbered))].append(k)
    index = {x: np.array(v) for x, v in index.items() if len(v) > 1}
    sizes, found = np.array([len(s) for s in sets]), []
    for k, s in enumerate(sets):
        near = [index[numbered[x]] for x in s if numbered[x] in index]
        if near:
            shared = np.bincount(np.concatenate(near), minlength=len(sets))
            found += [(k, int(h)) for h in np.flatnonzero(shared >= threshold * (sizes + len(s) - shared)) if h < k]
    return found


def test_near_dedup_recall(spark):
    """20,000 texts with a large family of near copies, a passage in many texts, and many medium families."""
    rnd = random.Random(21)
    word = lambda: f"{rnd.choice('abcdefghij')}{rnd.randint(0, 3000)}"
    text = lambda n: [word() for _ in range(n)]

    def changed(base, n):
        out = list(base)
        for _ in range(n):
            out[rnd.randrange(len(out))] = word()
        return out

    hot, passage = text(90), text(45)
    texts = [changed(hot, rnd.randint(0, 5)) for _ in range(1500)] + [passage + text(rnd.randint(15, 60)) for _ in range(1500)]
    for _ in range(300):
        base = passage + text(40) if rnd.random() < 0.3 else text(rnd.randint(20, 150))
        texts += [changed(base, rnd.randint(0, 3)) for _ in range(rnd.randint(2, 40))]
    while len(texts) < 20_000:
        texts.append(text(rnd.randint(3, 60)))
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(8)
    class_of = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    pairs = linked_pairs(texts)
    lost = sum(class_of[a] != class_of[b] for a, b in pairs)
    assert len(pairs) > 50_000 and lost <= 0.001 * len(pairs)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    assert all(find(i) == find(c) for i, c in class_of.items())
    apart = {(find(a), class_of[a]) for pair in pairs for a in pair}
    assert len(apart) <= 1.01 * len({r for r, _ in apart})
