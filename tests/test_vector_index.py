"""The pruned index against a search over everything."""

import numpy as np
import pytest

from spendlens.operators import retrieval as R, vector_index as V


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def best(rows, queries, k, threshold, allowed=None, sizes=(2, 12)):
    """Hits of each query in plain numpy, the best first; an index has vectors of one size."""
    out = {}
    for q, v in queries:
        v = v if v is not None and len(v) in sizes else None
        scored = [(round(float(unit(np.float64(x)) @ unit(np.float64(v))), 12), i) for i, x, c in rows
                  if x is not None and v is not None and len(x) == len(v) and (allowed is None or c in allowed)]
        hits = sorted((-s, i) for s, i in scored if s >= threshold)
        out[q] = [(i, round(-s, 9)) for s, i in (hits if k is None else hits[:k])]
    return {q: h for q, h in out.items() if h}


def found(hits, k):
    out = {}
    for h in sorted(hits.collect(), key=lambda h: (-round(h.score, 12), h.hit_id)):
        out.setdefault(h.query_id, []).append((h.hit_id, round(h.score, 9)))
    assert k is None or all(len(v) <= k for v in out.values())
    return out


@pytest.fixture(scope="module")
def rows():
    """Six clouds, far points, a third of copies of one vector, flat, missing and short vectors."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    made = [(centres[i % 6] + 0.15 * rng.normal(size=12)).astype(np.float32) for i in range(500)]
    made += [rng.normal(size=12).astype(np.float32) for _ in range(60)] + [made[7]] * 300
    made += [np.zeros(12, np.float32), -made[7], 3 * made[7], None, np.ones(5, np.float32), np.float32([]), np.zeros(12, np.float32)]
    return [(i, None if v is None else [float(x) for x in v], str(i % 3)) for i, v in enumerate(made)]


@pytest.fixture(scope="module")
def corpus(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, category string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return V.build(corpus, str(tmp_path_factory.mktemp("index")), cells=8, rows_per_part=40)


@pytest.fixture(scope="module")
def queries(spark, rows):
    asked = [(i, rows[i][1]) for i in [*range(0, 560, 20), 7, 860, 861, 862, 863, 864, 865]] + [(9000, [0.5] * 12)]
    return asked, spark.createDataFrame(asked, "query_id long, embedding array<float>")


@pytest.mark.parametrize("k, threshold", [(1, 0.5), (4, 0.1), (7, -0.2), (350, 0.9)])
def test_search(index, rows, queries, k, threshold):
    asked, df = queries
    assert found(V.search(index, df, k, threshold), k) == best(rows, asked, k, threshold)


def test_search_with_criteria(index, rows, queries):
    asked, df = queries
    got = found(V.search(index, df, 5, 0.2, {"category": ["0", "2"]}), 5)
    assert got == best(rows, asked, 5, 0.2, {"0", "2"})


@pytest.mark.parametrize("threshold", [-1.0, 0.0, 0.3, 0.95, 1.0])
def test_similar(index, rows, queries, threshold):
    asked, df = queries
    assert found(V.similar(index, df, threshold), None) == best(rows, asked, None, threshold)


def test_blocks_of_queries(index, rows, queries, monkeypatch):
    monkeypatch.setattr(R, "QUERIES_PER_BLOCK", 3)
    asked, df = queries
    assert found(V.similar(index, df, 0.6), None) == best(rows, asked, None, 0.6)


def test_a_higher_threshold_reads_less(index, rows, queries):
    df = queries[1].where("query_id < 500")
    shares = []
    for threshold in (0.0, 0.5, 0.8, 0.95):
        read = V.share_read(index, df, threshold).collect()
        assert len(read) == df.count()
        shares.append(np.mean([r.share for r in read]))
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.5 * shares[0], shares


def test_parts_are_bounded_and_cover_all(index, rows):
    sizes = index.vectors.groupBy("_ring", "_split").count().collect()
    assert sum(r["count"] for r in sizes) == len(rows) and max(r["count"] for r in sizes) <= 200
    copies = index.vectors.where("vec_id between 560 and 859").select("_split").distinct().count()
    assert copies > 1


def test_reopened(spark, corpus, queries, rows, tmp_path):
    V.build(corpus, str(tmp_path / "i"), cells=3)
    asked, df = queries
    again = V.open_index(spark, str(tmp_path / "i"))
    assert found(V.search(again, df, 3, 0.4), 3) == best(rows, asked, 3, 0.4)


@pytest.mark.parametrize("vectors", [[], [None], [[0.0, 0.0]], [[0.0, 0.0], [1.0, 0.0]], [[1.0, 1.0]] * 5])
def test_few_vectors(spark, tmp_path, vectors):
    rows = [(i, v, "0") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, category string")
    index = V.build(df, str(tmp_path / "i"))
    asked = [(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])]
    got = V.search(index, spark.createDataFrame(asked, "query_id long, embedding array<float>"), 3, -0.5)
    assert found(got, 3) == best(rows, asked, 3, -0.5)


def test_vectors_of_other_sizes_have_no_similarity(spark, corpus, rows):
    asked = [(1, rows[7][1]), (2, [1.0] * 5), (3, [1.0])]
    df = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    assert found(R.similar(corpus, df, 0.5), None) == best(rows, asked, None, 0.5, sizes=(1, 5, 12))
