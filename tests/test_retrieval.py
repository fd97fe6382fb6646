"""Chunks, corpora and exact search against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from spendlens import sources
from spendlens.functions import text as X
from spendlens.operators import retrieval as R


def test_short_text_is_one_chunk():
    assert X.split_text("hello  ") == ["hello"]


def test_coarsest_separator_wins():
    text = "\n\n".join(["a" * 600, "b" * 600, "c" * 100])
    assert X.split_text(text) == ["a" * 600, "b" * 600 + "\n\n" + "c" * 100]


def test_overlap_repeats_the_tail():
    words = [f"w{i:03d}" for i in range(500)]
    chunks = X.split_text(" ".join(words))
    assert all(len(c) <= 1000 for c in chunks)
    for left, right in zip(chunks, chunks[1:]):
        shared = set(left.split()) & set(right.split())
        assert 0 < len(" ".join(shared)) <= 200


def test_long_word_is_cut_by_characters():
    chunks = X.split_text("x" * 2500)
    assert [len(c) for c in chunks] == [1000, 1000, 900]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_chunks_cover_the_text(text):
    chunks = X.split_text(text, 40, 10)
    assert all(0 < len(c) <= 40 and c in text for c in chunks)
    letters = [c for c in text if not c.isspace()]
    assert sum(len([c for c in chunk if not c.isspace()]) for chunk in chunks) >= len(letters)
    assert bool(chunks) == bool(letters)


def test_chunk_documents(spark):
    df = spark.createDataFrame([("a", "x" * 1500, {"k": "v"}), ("b", "", None), ("c", None, None)],
                               "doc_id string, content string, metadata map<string,string>")
    rows = R.chunk_documents(df).orderBy("chunk_no").collect()
    assert [(r.doc_id, r.chunk_no, len(r.chunk), r.metadata["k"]) for r in rows] == [("a", 0, 1000, "v"), ("a", 1, 700, "v")]


def test_texts_reach_the_chunker_by_the_hundred(spark):
    """No whole Arrow batch of texts, whose size has no bound in bytes, is held by a worker."""
    df = spark.range(1000).selectExpr("id AS doc_id", "repeat('word ', 500) AS content")
    chunks = R.chunk_documents(df)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan
    assert chunks.count() == 3 * 1000


@pytest.fixture(scope="module")
def collection(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], str(i % 3)) for i in range(120)]
    rows += [(200, [0.0] * 8, "0"), (201, rows[5][1], "0"), (202, rows[5][1], "1")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, category string").cache()


def brute(collection, query_ids, k, threshold, categories=None):
    rows = collection.collect()
    unit = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows}
    unit = {i: v / n if (n := np.linalg.norm(v)) else v for i, v in unit.items()}
    out = {}
    for q in query_ids:
        scores = [(-float(unit[q] @ unit[r.vec_id]), r.vec_id) for r in rows
                  if categories is None or r.category in categories]
        out[q] = [i for s, i in sorted((round(s, 9), i) for s, i in scores if -s >= threshold)[:k]]
    return out


def asked(collection, ids):
    return collection.filter(collection.vec_id.isin(ids)).selectExpr("vec_id AS query_id", "embedding")


@pytest.mark.parametrize("block", [2, 1000])
def test_search(collection, block):
    ids = [0, 3, 5, 9, 40]
    hits = R.search(collection, asked(collection, ids), k=4, threshold=0.1, query_blocks=block).collect()
    got = {q: [h.hit_id for h in sorted(hits, key=lambda h: h.position) if h.query_id == q] for q in ids}
    assert got == brute(collection, ids, 4, 0.1)


def test_search_with_criteria(collection):
    hits = R.search(collection, asked(collection, [5]), k=9, threshold=0.2, criteria={"category": ["0", "1"]}).collect()
    assert [h.hit_id for h in sorted(hits, key=lambda h: h.position)] == brute(collection, [5], 9, 0.2, {"0", "1"})[5]


@pytest.mark.parametrize("length", [7, 10_000])
def test_blocks_follow_the_number_of_queries(spark, collection, monkeypatch, length):
    """Every row asks; blocks of a few queries and Arrow batches of a few rows give the same as brute force."""
    monkeypatch.setattr(R, "QUERIES_PER_BLOCK", length)
    ids = list(range(120)) + [200, 201, 202]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        hits = R.search(collection, asked(collection, ids), k=4, threshold=0.1).collect()
        similar = R.similar(collection, asked(collection, ids), threshold=0.1)
        pairs = similar.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert f"sequence(0, {-(-123 // length) - 1}," in similar._jdf.queryExecution().analyzed().toString()
    got = {q: [h.hit_id for h in sorted(hits, key=lambda h: h.position) if h.query_id == q] for q in ids}
    assert got == brute(collection, ids, 4, 0.1)
    whole = brute(collection, ids, 1000, 0.1)
    assert sorted((h.query_id, h.hit_id) for h in pairs) == sorted((q, i) for q in ids for i in whole[q])


def test_search_without_queries(collection):
    assert R.search(collection, asked(collection, [-1])).count() == 0


def test_citations(spark):
    hits = spark.createDataFrame([(1, 1, "text", {"source": "s"})],
                                 "query_id int, position int, content string, metadata map<string,string>")
    assert tuple(R.citations(hits).first()) == (1, 1, "text...", "s", "general")


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(X.unit_vector("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(X.cosine_similarity(df.v, df.v)).collect()[1][0] is None


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id int, category string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "vec_id int, category string, version int")
    got = R.upsert(old, new, order_by="version")
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, "y"), (3, "z")}
    assert {r.vec_id for r in R.delete_points(got, old.filter("vec_id = 1")).collect()} == {2, 3}
    assert R.clear(got).isEmpty()


def test_token_costs(spark):
    df = spark.createDataFrame([(1, "user", "x" * 4003, "gpt-4-turbo"), (1, "assistant", "y" * 400, "gpt-4-turbo"),
                                (2, "user", "z" * 400, "nobody")], "conv_id int, role string, text string, model string")
    got = {r.conv_id: (r.input_tokens, r.output_tokens, r.cost) for r in R.token_costs(df, "conv_id").collect()}
    assert got == {1: (1000, 100, 0.013), 2: (100, 0, 0.003)}


def test_load_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "tax_guide.txt").write_text("line one\nline two")
    (tmp_path / "sub" / "stock.md").write_text("# Title")
    (tmp_path / "risk.html").write_text(
        "<html><head><title>t</title></head><body><!-- c --><p>A &lt; B</p><script>x</script> &amp; C</body></html>")
    (tmp_path / "rows.csv").write_text("a,1\n\nb,2\n")
    (tmp_path / "skip.bin").write_text("no")
    rows = {(r.metadata["source"], r.content): r.metadata for r in sources.load_documents(spark, str(tmp_path)).collect()}
    assert {k: (m["type"], m["category"]) for k, m in rows.items()} == {
        ("tax_guide.txt", "line one\nline two"): ("txt", "tax"), ("stock.md", "# Title"): ("md", "investment"),
        ("risk.html", "A < B & C"): ("html", "risk"), ("rows.csv", "a,1"): ("csv", "general"),
        ("rows.csv", "b,2"): ("csv", "general")}


def test_corpus_build(spark):
    seed = sources.seed_documents(spark, [("rule text", {"jurisdiction": "EU"}), ("guide", {"author": "me"})])
    chunks = R.build_corpus(seed, R.save_document("note " * 300, {"source": "x"}, spark)).collect()
    assert len(chunks) == 4 and {c.metadata.get("jurisdiction") for c in chunks} == {"EU", None}
