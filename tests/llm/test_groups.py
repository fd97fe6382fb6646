"""Near-duplicates, components, conversations and the pipeline against brute force."""

import random

import duckdb
import pandas as pd
import pytest
from llm_tables import documents

import corpus_pipeline
from spendlens.llm import chat, neardup
from spendlens.llm.common import map_batches
from spendlens.llm.components import components
from spendlens.llm.queries import ORACLE, QUERIES


def smallest(nodes, links):
    parent = {n: n for n in nodes}
    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts, percent=85):
    sets = {i: plain_set(t) for i, t in texts.items()}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return smallest(sets, links), sets


@pytest.fixture(scope="module")
def copies():
    """Copies with independent edits around the limit, chains of edits, exact copies, short and empty texts."""
    rng = random.Random(12)
    def text(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]
    def edit(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
        return words
    texts = [" ".join(text(rng.randrange(1, 80))) for _ in range(60)]
    for _ in range(4):
        base = text(120)
        texts += [" ".join(edit(base, rng.randrange(0, 6))) for _ in range(30)]
    chain = text(150)
    for _ in range(15):
        chain = edit(chain, 2)
        texts.append(" ".join(chain))
    texts += [texts[3]] * 20 + [None, "", "  \n", "A b C", "a B c", "Ä b c", "ä b c", "a b"]
    order = rng.sample(range(10 * len(texts)), len(texts))
    return dict(zip(order, texts))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, copies, percent):
    expected, sets = plain_components(copies, percent)
    rows = neardup.near_duplicates(documents(spark, list(copies.items())).repartition(4), percent, 60).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_links_beyond_bucket_centres(spark, copies):
    """The prefix filter alone finds every link inside a group."""
    docs = documents(spark, list(copies.items()))
    sets = neardup.shingle_sets(docs).where("n > 0").cache()
    members = sets.selectExpr("1L as `group`", "doc_id as part", "doc_id")
    pairs = neardup.prefix_pairs(members, sets, 85)
    found = {(r.a, r.b) for r in neardup.confirmed(pairs, sets, 85).collect()}
    _, plain = plain_components(copies)
    ids = sorted(i for i in plain if plain[i])
    assert found == {(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
                     if 100 * len(plain[a] & plain[b]) >= 85 * len(plain[a] | plain[b])}


def test_min_max_estimates_likeness():
    maker, rng = neardup.MinMax(400, 5), random.Random(1)
    a = [f"a{rng.random()} b c d e" for _ in range(300)]
    sets = [neardup.shingle_set("\n".join(a)), neardup.shingle_set("\n".join(a[:250] + ["x y z"] * 2))]
    one, two = map(maker.signature, sets)
    true = len(set(sets[0]) & set(sets[1])) / len(set(sets[0]) | set(sets[1]))
    assert abs((one == two).mean() - true) < 0.06


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame([(g, a, b) for g in (0, 1) for a, b in links if g == 0 or a < 100], "graph int, a long, b long")
    rows = components(df).collect()
    for g in (0, 1):
        own = [(a, b) for a, b in links if g == 0 or a < 100]
        expected = smallest({n for x in own if x[0] != x[1] for n in x}, own)
        assert {r.node: r.component for r in rows if r.graph == g} == expected
    assert components(df.limit(0)).count() == 0


def test_odd_documents(odd):
    rows = neardup.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count()
    assert (by[5].component_id, by[6].component_id, by[6].kept) == (5, 5, False)
    assert by[None].component_id is None and by[None].kept and by[1].n_shingles == 0 and by[1].kept
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


# --- conversations ----------------------------------------------------------------------------------------

def test_chats_equal_sql(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(40):
        turns = [(t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "é\n"])) for t in range(rng.randrange(1, 7))]
        for k in range(1, len(turns) + 1):
            if k == len(turns) or rng.random() < 0.4:
                rows += [(conv * 10 + k, *t) for t in turns[:k]]
    rows += [(900, i, "user", f"t{i}") for i in range(600)] + [(901, i, "user", f"t{i}") for i in range(300)]
    rows += rows[:10] + [(902, None, None, None), (None, 1, "user", "x"), (903, 2, "user", "a"), (903, 2, "user", "b")]
    schema = "conv_id long, turn long, role string, text string"
    conversations = spark.createDataFrame(rows, schema).repartition(3)
    out = chat.chats(conversations.withColumn("block", conversations.role)).toPandas()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    expected = duckdb.sql(chat.SQL).df()
    keys = ["conv_id", "block"]
    pd.testing.assert_frame_equal(out.sort_values(keys, ignore_index=True), expected[out.columns].sort_values(keys, ignore_index=True),
                                  check_dtype=False)
    assert 901 not in set(out.conv_id) and (out.conv_id == 900).sum() == 3
    assert chat.chats(spark.createDataFrame([], schema)).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.dtypes == docs.dtypes, name
        if name == "near_duplicates":
            expected, _ = plain_components({r.doc_id: r.text for r in docs.collect()}, 80)
            assert {r.doc_id for r in out.collect()} == set(expected.values())
        if name == "personal_data":
            assert out.count() == docs.count() and out.where("n_chars <> length(text)").count() == 0
            assert out.where("text rlike '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+'").count() == 0
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == ids


def test_pipeline_on_odd_and_empty_documents(spark, sf_dir, odd):
    for docs in (odd, odd.limit(0)):
        docs = docs.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()


def test_repeated_and_unnamed_rows_in_the_dedup_stage(spark, odd, sf_dir):
    rows = corpus_pipeline.first_of_group(spark, odd, sf_dir).collect()
    assert sorted((r.doc_id for r in rows), key=str) == [1, 2, 3, 4, 5, 7, None]


def test_different_texts_under_one_id_in_the_dedup_stage(spark, sf_dir):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    docs = documents(spark, [(3, a), (5, a), (5, b), (5, b), (6, c), (6, b + " end"), (None, a)]).select(*corpus_pipeline.COLUMNS)
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.first_of_group(spark, docs, sf_dir).collect()]
    one_of_b = set(rows) - {(3, a), (6, c), (None, a)}
    assert len(rows) == 4 and one_of_b in ({(5, b)}, {(6, b + " end")})


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    from check import compare, duck

    assert compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE[name]).startswith("ok")


def test_sets_of_one_id_are_in_one_component(spark):
    """Rows 1 and 2 differ, but id 3 has the texts of both."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = neardup.near_duplicates(documents(spark, [(1, a), (2, b), (3, a), (3, b), (4, c), (5, c + " x")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [
        (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 4, False)]


def test_rows_without_removed_keys(spark):
    rows = spark.range(5000).selectExpr("id AS key", "id * 2 AS value").unionByName(
        spark.createDataFrame([(None, 1), (None, 2)], "key long, value long"))
    left = neardup.without(rows, spark.range(0, 5000, 3).selectExpr("id AS key"), "key").collect()
    assert sorted((r.key, r.value) for r in left if r.key is not None) == [(i, 2 * i) for i in range(5000) if i % 3]
    assert sorted(r.value for r in left if r.key is None) == [1, 2]


def test_dedup_stage_reads_distinct_documents_twice_at_most(spark, sf_dir, tmp_path):
    """Rows of one id or text have steps of their own; without any, the plan has none of these."""
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    documents(spark, [(1, a), (2, a + " end"), (3, b), (4, b), (5, "c d e")]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline.first_of_group(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= sum("Relation" in line and "n_chars" in line for line in plan.splitlines()) <= 2


def test_marks_of_no_keys(spark):
    rows = neardup.marked(spark.range(5), spark.range(0), "id")
    assert [r._marked for r in rows.collect()] == [False] * 5
    assert neardup.components(spark.createDataFrame([], "graph int, a long, b long")).count() == 0


def test_workers_take_documents_in_pieces(spark, monkeypatch):
    sizes = map_batches(spark.range(1200).coalesce(1), lambda b: [[b.num_rows] * b.num_rows], "n bigint", 500)
    assert sorted(r.n for r in sizes.distinct().collect()) == [200, 500]
    assert map_batches(spark.range(0), lambda b: [b.column(0)], "n bigint", 500).count() == 0
    pieces = []
    monkeypatch.setattr(neardup, "map_batches", lambda df, make, schema, rows=None: pieces.append(rows) or df)
    docs = documents(spark, [(1, "a b c")])
    neardup.signed(docs)
    neardup.shingle_sets(docs)
    assert pieces == [neardup.ROWS_PER_PIECE] * 2
