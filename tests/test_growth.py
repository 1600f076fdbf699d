"""Steps that must not grow faster than their input: what plans shuffle and find anew, and that results stay the same."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import python
from palimpsest.operator_queries import QUERIES
from palimpsest.operators import edits, grounding
from palimpsest.sources import stores

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_matches_without_shuffle(spark):
    """pairs of sentences were shuffled with whole rows; ties, empty and null sentences, and ends of windows by brute force."""
    src, tgt = [["a", "b", "c", "d", "e"], None, ["x"], ["a", "b", "c", "d"], []], [["x"], ["a", "b", "c", "d"], ["a", "b", "c", "d"], None, ["a", "b", "c", "d", "e"]]
    given = [(1, src, tgt), (2, tgt, src), (3, src, [["x"]]), (4, src, []), (5, None, tgt), (6, src, None), (7, tgt * 200, src * 200)]
    df = spark.createDataFrame(given, "k int, src_sents array<array<string>>, tgt_sents array<array<string>>")
    found = edits.match_sentences(2, 1)(df)
    assert "Exchange" not in plan(found)
    assert found.columns == ["row_id", "i", "k", "src_sents", "tgt_sents", "source", "target", "match_score"]
    wanted = []
    for k, a, b in given:
        for i, s in enumerate(a or []):
            scores = [(python.bleu(s or [], b[j] or []), -j) for j in range(max(0, i - 2), min(len(b or []), i + 2))]
            if scores:
                score, j = max(scores)
                wanted.append((k, i, s, b[-j], score))
    assert sorted((r.k, r.i, r.source.tokens, r.target.tokens, r.match_score) for r in found.collect()) == sorted(wanted, key=lambda x: x[:2])


def test_diff_of_lists(spark):
    """the diff by Arrow arrays: nulls, empty lists, null tokens, and more rows than are Python objects at a time."""
    given = [(k, *x) for k in range(300) for x in [(["a", "b"], ["b", "c"]), (None, ["a"]), (["a"], None), ([], []), ([None, "é"], ["é", None])]]
    df = spark.createDataFrame(given, "k int, a array<string>, b array<string>").coalesce(1)
    found = df.select("k", "a", "b", python.seq_diff("a", "b").alias("d")).filter(F.size("d.src") >= 0).collect()
    assert len(found) == len(given)
    assert all((r.d.src, r.d.tgt) == python.changed_indices(r.a or [], r.b or []) for r in found)


@pytest.mark.parametrize("kind, given", [
    ("int", [([1, 2], [2, 3]), (None, [1]), ([2, None], [None, 2]), ([None], [None]), ([], [])]), ("boolean", [([True], [False, None]), ([None], [None])]),
    ("double", [([1.5, None], [2.5, 1.5, None])]), ("void", [([], [None]), ([None], [None]), (None, [])]), ("binary", [([b"a", None], [b"b", b"a"])]),
])
def test_diff_of_lists_without_texts(spark, kind, given):
    """The step of F4, F5 and F8: bytes of texts were asked of all values, which failed; nulls of numbers weren't equal to each other."""
    text = lambda x: "null" if x is None else f"x'{x.hex()}'" if kind == "binary" else f"cast({x} as {kind})"
    array = lambda x: f"cast({'null' if x is None else 'array(' + ','.join('null' if v is None else text(v) for v in x) + ')'} as array<{kind}>)"
    for a, b in given:
        d = spark.range(1).selectExpr(f"{array(a)} a", f"{array(b)} b").select(python.seq_diff("a", "b").alias("d")).first().d
        assert (d.src, d.tgt) == python.changed_indices(a or [], b or [])


def evaluations(spark, name):
    return plan(QUERIES[name](spark, SMALL)).count("ArrowEvalPython")


def test_addition_chain_finds_the_diff_once(spark):
    """filters on the diff were pushed below it, each with Python workers of its own."""
    assert evaluations(spark, "addition_chain") == 1


def test_ablation_shuffles_each_text_once(spark, tmp_path):
    """whole texts of documents and pages went through several shuffles; repeated documents and pages keep their rows."""
    docs = [(i % 7, f"text {i} of a document", "en", "s", 20) for i in range(9)] + [(None, "x", "en", "s", 1), (8, None, "en", "s", 0)]
    pages = [(i, f"http://h/{i}.html", f"<article><p>page {i}</p></article>") for i in range(5)] + [(3, "http://h/3.html", "<article><p>longer page 3</p></article>")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    texts = {u: max((g for _, v, g in pages if v == u), key=len)[12:-14] for _, u, _ in pages}
    wanted = []
    for k, t, *_ in docs:
        for p, u, _ in pages if k is not None else []:
            for q, v, _ in pages:
                if p % 6 == k % 6 and (q + 1) % 6 == k % 6 and u != v:
                    a, b = (None, None) if t is None else (t[: len(t) // 2], t[len(t) // 2 :])
                    wanted.append((a, texts[u], b, texts[v], b and b[::-1]))
    made = QUERIES["ablation_pairs"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, wanted)) and len(wanted) > 5
    # Exchanges that a column of page or document texts goes through: documents, longest text, texts of a key.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(QUERIES["ablation_pairs"](spark, SMALL)).split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [lines[i + 1] for i, line in enumerate(lines) if " Exchange " in line]
    assert len([x for x in below if any(w in x for w in ("text#", "prefix#", "partial_"))]) == 3


def test_json_map_files_are_bounded(spark, tmp_path):
    """all entries went into `files` files, however large; each is read by one task, as one string."""
    given = {f"k{i}": "v" * i for i in range(300)} | {"none": None, "long": "é" * 5000}
    df = spark.createDataFrame([*given.items(), (None, "gone")], "k string, v string").repartition(5)
    stores.write_json_map(df, "k", "v", str(tmp_path / "m"), files=3, max_bytes=4000)
    sizes, found = [], {}
    for name in os.listdir(tmp_path / "m"):
        if name.endswith(".txt"):
            sizes.append(os.path.getsize(tmp_path / "m" / name))
            found |= json.load(open(tmp_path / "m" / name, encoding="utf-8"))
    assert found == given and len(sizes) > 10 and sorted(sizes)[-2] < 8000
    assert {r.key: r.value for r in stores.read_json_map(spark, str(tmp_path / "m"), "string").collect()} == given
    stores.write_json_map(df, "k", "v", str(tmp_path / "f"), files=3)
    assert len([n for n in os.listdir(tmp_path / "f") if n.endswith(".txt")]) <= 3
    with pytest.raises(ValueError):
        stores.write_json_map(df, "k", "v", str(tmp_path / "n"), max_bytes=0)


@pytest.mark.parametrize("name", ["sentence_changes", "split_edit_spans", "seq_diff_added_tokens", "sentences_pruned"])
def test_diffs_are_found_once(spark, name):
    """F4, F5, F6, F8: filters on the diff were pushed below it, each with Python workers of its own."""
    assert evaluations(spark, name) == 1


def test_control_tokens_of_frequent_words(spark, monkeypatch):
    """the most frequent words went to one task each. Frequent, rare, absent, repeated and null words by brute force."""
    frequency = [("the", 5e6), ("of", 4e6), ("and", 4e6), ("a", 30.0), ("b", 20.0), ("c", 20.0), ("d", 1.0), ("a", 25.0), ("e", None), (None, 1.0)]
    given = [(1, ["the", "of", "and"], ["x"]), (2, ["the", "new"], []), (3, ["the", "a", "b"], ["the", "a"]), (4, [], ["a"]), (5, None, None), (6, ["c", "b"], ["b", "c"]), (7, ["e", "the"], []), (8, ["the", "d"], ["the"]), (9, ["z", "y"], []), (1, ["d"], []), (10, [None, "the"], [])]
    rows = spark.createDataFrame(given, "id int, target array<string>, grounding array<string>")
    table = spark.createDataFrame(frequency, "word string, count double")
    least = {}
    for w, n in frequency:
        least[w] = min(least.get(w, 1e9), 1e6 if n is None else n)
    wanted = {}
    for k, target, other in given:
        shared = [w for w in target or [] if w in (other or [])] or target or [None]
        for w in shared:
            rank = (1e6 if w is None else least.get(w, 1e6), w is not None, w or "")
            wanted[k] = min(wanted.get(k, rank), rank)
    wanted = {k: w[2] if w[1] else "n/a" for k, w in wanted.items()}
    for hot in (1000, 3, 1):
        monkeypatch.setattr(grounding, "HOT_WORDS", hot)
        assert {r.id: r.control for r in grounding.control_tokens(rows, table, "id").collect()} == wanted
        assert grounding.control_tokens(rows, table.limit(0), "id").count() == len(wanted)


def test_frequent_words_are_not_joined(spark):
    """of 4000 rows with the same three words, none goes by its word."""
    rows = spark.range(4000).select("id", F.array(F.lit("the"), F.lit("of"), F.lit("and")).alias("target"), F.array(F.lit("of"), F.lit("the")).alias("grounding"))
    table = spark.createDataFrame([("the", 9), ("of", 8), ("and", 7)], "word string, count long")
    found = grounding.control_tokens(rows, table, "id")
    assert found.groupBy("control").count().collect() == [("of", 4000)]
    assert "own_best" in plan(found)


def test_wide_rows_are_few_at_a_time():
    """256 rows were Python objects at a time, however long. Nulls, empty and nested lists, slices; a row over the bound is alone."""
    tokens = [[f"w{i}" for i in range(n)] for n in [20_000] * 40 + [0, 3, 400_000, 1]] + [None, [None, "é"]] * 300
    kind = pa.list_(pa.string())
    nested = [None if t is None else [t[:5], None, t[5:]] for t in tokens]
    for rows, a in [(tokens, pa.array(tokens, kind)), (tokens[1:], pa.array(tokens, kind).slice(1)), (nested, pa.array(nested, pa.list_(kind)))]:
        parts = [list(p) for p in python._parts(a, a)]
        assert [r for p in parts for r in p] == [(r or [], r or []) for r in rows]
        flat = lambda x: [t for y in x for t in (y if isinstance(y, list) else [y])]
        size = lambda p: sum(64 + len((t or "").encode()) for r in p for x in r for t in flat([s or [] for s in x] if rows is nested else x))
        assert all(len(p) == 1 or (len(p) <= 256 and size(p) <= 16_000_000) for p in parts)
    assert [list(p) for p in python._parts(a[:0], a[:0])] == []
