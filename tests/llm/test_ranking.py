"""URL filters, resampling and search against plain Python and DuckDB."""

import math
import random
import re
import zlib
from collections import Counter
from fnmatch import translate
from hashlib import sha256

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
from llm_tables import documents

from spendlens.llm import lexical, resampling, url_rules
from spendlens.llm.common import Workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sql(query, **tables):
    """Rows of DuckDB over tables given as (columns, rows)."""
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return con.execute(query).fetchall()


# --- URL filters ----------------------------------------------------------------------------------------

PARTS = ["http://", "https://", "://", "/", "?", "#", ".", "-", "&", "=", "org", "com", "ORG", "example.org", "Example.Org", "fr", "de",
         "/en/1", "/es/", "pills", "x-pills.", "spam-farm.", "login", "/login", "cart", "casino", "docs.", "help/", "sessionid=", ".jpg",
         "é", "😀", "%20", " ", "\n", "1", "12", ":8080", "@", "_"]


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(1500)]
    hosts = ["org", "a.org", "myorg", "example.org", "www.example.org", "notexample.org", "x.com", "com", "EXAMPLE.ORG", "org:80", "docs.x.net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/", "/fr/9", "/de/x?q", "/login", "/login/", "/help/a/login?x", "/a/calendar/1/2/"]
    made += [f"{s}{h}{p}{e}" for s in ("http://", "x://") for h in hosts for p in paths for e in ("", "?a=1", "#t")]
    return [None, "", "http://", "org/", "://org/", "a" * 100_000, "http://a" + "/calendar" * 20_000, "http://" + "-a." * 30_000 + "org/", *made]


def test_urls_by_inline_index_by_join_and_by_sql(spark, urls):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    inline = sorted(tuple(r) for r in url_rules.judge(pages).collect())
    assert inline == sorted(tuple(r) for r in url_rules.judge(pages, inline_rules=0).collect())
    expected = sql(url_rules.SQL, pages=("page_id BIGINT, url VARCHAR", [(i, u) for i, u in enumerate(urls)]))
    key = str
    assert sorted(inline, key=key) == sorted(expected, key=key)
    assert {"org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None} == {r[3] for r in inline}


def test_hosts_and_paths(spark):
    rows = {None: ("", ""), "x": ("", ""), "http://A.É.org:80/P?q#f": ("a.É.org:80", "/P"), "a://b#c/d": ("b", ""), "a://b?c/d": ("b", ""),
            "a://b/c://d": ("b", "/c://d"), "a\n://B/c\nd": ("b", "/c\nd")}
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    assert {r.page_id: (r.host, r.path) for r in url_rules.judge(pages).collect()} == dict(enumerate(rows.values()))


def test_patterns_against_shell_patterns(spark):
    """Any pattern of literals and stars finds what the shell's matching finds."""
    rng = random.Random(6)
    def made(n, letters):
        return "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
    patterns = sorted({made(7, "ab./-*") for _ in range(120)} - {"*", "**"})
    texts = [made(12, "ab./-") for _ in range(80)]
    rules = spark.createDataFrame([(p, "block", False) for p in patterns], "rule string, verdict string, is_host boolean")
    kinds = {r.rule: r for r in url_rules.compiled(rules).collect()}
    for p in patterns:
        shell = re.compile(translate(f"*{p}*"))
        tokens = kinds[p].tokens
        for t in texts:
            fits = bool(re.match(kinds[p].expression.replace(r"\z", r"\Z"), t))
            assert fits == bool(shell.match(t)), (p, t)
            assert not fits or set(tokens) <= set(re.split("[^ab]+", t)), (p, t, tokens)


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://a.org/common/{i}") for i in range(9)] + [(9, "http://b.org/rare/common")], "page_id long, url string")
    rules = spark.createDataFrame([("/common/rare/", "block", False), ("/rare/common|", "block", False), ("com*", "block", False),
                                   ("b.org/", "allow", True), (None, "block", False), ("/x/", None, False), ("b.org/", "allow", True)],
                                  "rule string, verdict string, is_host boolean")
    made = url_rules.compiled(rules)
    index = {r.rule: r.token for r in url_rules.filed(made, pages, None).collect()}
    assert index == {"/common/rare/": "rare", "/rare/common|": "rare", "com*": "", "b.org/": "b"}
    for inline in (0, 10):
        found = {r.page_id: (r.rule, r.verdict, r.pattern) for r in url_rules.judge(pages, rules, inline).collect()}
        assert found == {i: (None, "block", "com*") for i in range(9)} | {9: ("b.org/", "allow", None)}


def test_no_urls_no_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(pages).count() == url_rules.judge(pages, inline_rules=0).count() == 0
    one = spark.createDataFrame([(None, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame([], "rule string, verdict string, is_host boolean")
    assert [tuple(r) for r in url_rules.judge(one, rules).collect()] == [(None, "a.org", "/", None, "allow", None)]


def test_urls_are_judged_without_python_or_shuffle(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_rules.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- resampling -----------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, low=1, high=2):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def drawn(docs, targets, percent=25, ngrams=(1, 2), buckets=10_000, seed=7, min_words=20):
    def of(text):
        return [zlib.crc32(g.encode()) % buckets for g in grams(text, *ngrams)]
    corpus, aim = Counter(), Counter()
    for _, t in docs:
        corpus.update(of(t))
    for t in targets:
        aim.update(of(t))
    s, n = sum(corpus.values()), sum(aim.values())
    rows = []
    for doc_id, text in docs:
        own = of(text)
        gain = sum(math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (n + buckets)))) for b in own)
        weight = gain // len(own) if own else 0
        h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc_id, len(own), weight, score, None, len(grams(text, 1, 1))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    parts = ["a", "b", "The", "the", "of", "é", "日本", "1", "x" * 60, " ", " ", " ", "\n", ", ", "-", "\0", "\x85", "_"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(300)]
    return [None, "", " \n", "A", "A b", " a. b! ", "of the " * 30_000, "y" * 200_000, "ab " * 20 + "z" * 500, *made, *made[:40]]


@pytest.mark.parametrize("settings", [{}, {"ngrams": (2, 3), "buckets": 97, "percent": 60, "seed": 3, "min_words": 5}, {"buckets": 70_000}])
def test_resampling_equals_plain_python(spark, texts, settings, monkeypatch):
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(3, texts[20]), (3, texts[20]), (3, texts[21])]
    targets = [None, "", "the a b of é 日本", "the the the a", texts[30]]
    target = spark.createDataFrame([(t, 1, "x") for t in targets], "text string, doc_id int, row string")
    table = documents(spark, docs).repartition(3)
    found = sorted((tuple(r) for r in resampling.resample(table, target, **settings).collect()), key=str)
    assert found == drawn(docs, targets, **settings)


def test_spans_in_pieces(monkeypatch):
    """Texts scanned together, in pieces of any length, give the n-grams of each text alone."""
    rng = random.Random(9)
    for piece, high in ((4, 1), (5, 2), (7, 3), (1 << 20, 3)):
        monkeypatch.setattr(resampling, "PIECE", piece)
        group = [" ".join(rng.choice(["a", "bb", "ccc", "d" * 60]) for _ in range(rng.randrange(12))) for _ in range(9)]
        raw = b"\n".join(resampling.collapsed(t.encode()) for t in group)
        found = Counter(b for _, bs in resampling.hashed_features(raw, (1, high), 1 << 32) for b in bs.tolist())
        assert found == Counter(zlib.crc32(g.encode()) for t in group for g in grams(t, 1, high))


def test_spans_are_those_of_an_overlapped_search():
    text = resampling.collapsed("One two, two--three".encode())
    assert text == b" one two two three "
    pairs = regex.findall(r"(?<![^ ])[^ ]+ [^ ]+(?![^ ])", text.decode().strip(), overlapped=True)
    assert pairs == [g for g in grams("One two, two--three") if " " in g]


def test_resampling_equals_sql(spark, texts):
    docs = [(i, t.replace("\0", "") if t else t) for i, t in enumerate(texts) if t is None or len(t) < 2000]
    expected = sql(resampling.SQL, documents=("doc_id BIGINT, text VARCHAR", docs), benchmark=("text VARCHAR", [("the a b of é",), (None,)]))
    found = resampling.resample(documents(spark, docs), spark.createDataFrame([("the a b of é",), (None,)], "text string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_resampling_of_nothing(spark, odd):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(documents(spark, []), none).count() == 0
    rows = resampling.resample(odd, none).collect()
    assert len(rows) == odd.count() and sum(r.rank is not None for r in rows) == 25 * 2 // 100
    assert {r.doc_id: r.weight for r in rows if not r.n_features} == {1: 0, 2: 0, 3: 0}


# --- search ---------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranking(docs, items, k=20):
    """The contract, document by document."""
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def searched(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    """Frequent words that often meet, rare ones, ties, copies and long texts."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    made = [" ".join(rng.choices(words, weights, k=rng.randrange(1, 30))) for _ in range(500)]
    return [None, "", "--", "W0, w1! É é", "w0 " * 40_000, *made, *made[:30]]


def items_of(corpus):
    rng = random.Random(12)
    return [(1, None), (2, ""), (3, "unknown words"), (4, "w0"), (5, "w0 w0 w1 w1 w1 W2"), (6, corpus[9]), (6, corpus[10]), (None, "w3 w30"),
            (8, " ".join(corpus[20:40]))] + [(i, " ".join(f"w{rng.randrange(45)}" for _ in range(rng.randrange(1, 25)))) for i in range(9, 60)]


@pytest.mark.parametrize("k, block_terms, segment", [(20, 1 << 20, 1 << 14), (3, 1 << 20, 16), (5, 60, 50), (600, 1 << 20, 7)])
def test_search_equals_plain_python(spark, corpus, k, block_terms, segment, monkeypatch):
    docs = [(i if i != 25 else None, t) for i, t in enumerate(corpus)] + [(7, corpus[12]), (7, corpus[13])]
    items = spark.createDataFrame([(i, t, 0) for i, t in items_of(corpus)], "item_id long, text string, row int")
    table = documents(spark, docs).repartition(2)
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", segment)
    by_value = lexical.postings
    monkeypatch.setattr(lexical, "postings", lambda d, v: by_value(d, v))
    assert searched(lexical.search(table, items, k, block_terms)) == ranking(docs, items_of(corpus), k)


def test_search_equals_sql(spark, corpus):
    items = [(i, t) for i, t in items_of(corpus) if i is not None and i != 6]
    docs = list(enumerate(corpus))
    expected = sql(lexical.SQL, documents=("doc_id BIGINT, text VARCHAR", docs), benchmark=("item_id BIGINT, text VARCHAR", items))
    found = lexical.search(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert searched(found) == sorted(expected, key=str)


def test_search_of_nothing(spark, odd):
    items = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(documents(spark, []), items).count() == 0
    assert lexical.search(odd, none).count() == 0
    assert {(r.doc_id, r["rank"]) for r in lexical.search(odd, items).collect()} == {(4, 1), (4, 2)}


def segment_of(docs):
    """A segment from documents as {term: impact}; all pairs of terms have lists."""
    terms = sorted({t for d in docs for t in d})
    segment = lexical.Segment.__new__(lexical.Segment)
    segment.doc_ids, segment.size = np.arange(len(docs)), len(docs)
    segment.lists, segment.pairs = {}, {}
    for t in terms:
        at = np.array([i for i, d in enumerate(docs) if t in d])
        impact = np.array([docs[i][t] for i in at])
        segment.lists[t] = (at, impact, int(impact.max()))
    pairs = {}
    for k, (a, b) in enumerate((a, b) for a in terms for b in terms if a < b):
        pairs[a, b] = k
        at = np.array([i for i, d in enumerate(docs) if a in d and b in d], np.int64)
        if len(at):
            segment.pairs[k] = (at, max(docs[i][a] + docs[i][b] for i in at))
    return segment, pairs


def test_pair_bounds_hold_and_skip_more_than_single_ones():
    rng = random.Random(13)
    scanned = {True: 0, False: 0}
    for _ in range(60):
        docs = [{t: rng.randrange(1, 100) for t in range(8) if rng.random() < 0.5 and (t < 4) == (i % 2 == 0)} for i in range(200)]
        docs[0] = {7: 400, 6: 390, 1: 5}
        segment, pairs = segment_of(docs)
        times = {t: rng.randrange(1, 3) for t in range(8)}
        expected = sorted(((-sum(n * times[t] for t, n in d.items()), i) for i, d in enumerate(docs) if d))[:5]
        for paired in (True, False):
            groups = [(0, 4), (1, 5), (2, 6), (3, 7)] if paired else [(t,) for t in range(8)]
            units = [lexical.Unit(segment, g, times, pairs.get(g)) for g in groups]
            best = lexical.Best(5)
            best.add(np.array([-s for s, _ in expected[:5]]) - 1, np.array([10**6 + i for i in range(5)]))  # a threshold just below
            lexical.search_segment(segment, units, best)
            assert list(zip((-best.scores).tolist(), best.ids.tolist()))[:1] == expected[:1]
            scanned[paired] += best.scanned + best.probed
    assert scanned[True] < scanned[False]


def test_workspace_keeps_only_what_is_named(spark):
    with Workspace(spark, "test") as work:
        kept = work.stored(spark.range(3), "a", keep=True)
        work.stored(spark.range(3), "b")
        assert sorted(work.tables) == ["a", "b"]
    assert work.tables == ["a"] and kept.count() == 3
    with pytest.raises(ValueError), Workspace(spark, "test") as work:
        work.stored(spark.range(3), "a", keep=True)
        raise ValueError
    assert pd.isna(None) and work.tables == []
