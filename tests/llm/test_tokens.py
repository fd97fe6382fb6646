"""Token counts, encoding and packing against the tokenizer libraries."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from llm_tables import documents
from tokenizers import Tokenizer

from spendlens.llm import bpe, packing, token_count
from spendlens.llm.merging import merge

ALPHABET = "aeThs  ' \n\t'é½²中文字 한😀▁\x85　́İſǅª123\0|<>"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    odd = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50))) for _ in range(300)]
    return [None, "", " ", "  the   the\n\n the ", "<|endoftext|>a <|endoftext|>", "<s> </s>", "word " * 9000, *odd, *odd[:5]]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_merge_takes_lowest_rank_then_leftmost():
    ranks = {("a", "b"): (1, "ab"), ("b", "c"): (0, "bc"), ("a", "a"): (2, "aa"), ("a", "bc"): (3, "abc")}
    assert merge("abc", ranks) == ["abc"]
    assert merge("aaab", ranks) == ["aa", "ab"]
    assert merge("", ranks) == [] and merge("x", ranks) == ["x"]


def test_counts_equal_the_library(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for row in token_count.token_counts(documents(spark, texts)).collect():
        text = texts[row.doc_id] or ""
        assert row.n_tokens == len(model.encode(text)) and row.n_bytes == len(text.encode())
        assert row.over_limit == (row.n_tokens > 4096)


def test_round_trip_equals_the_library(spark, texts):
    model = library("byte_bpe_50k.json")
    docs = documents(spark, texts)
    expected = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    for row in bpe.round_trip(docs).collect():
        ids = expected[row.doc_id]
        back = model.decode(ids, skip_special_tokens=False).encode()
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(back).hexdigest()
    encoded = bpe.encode(docs)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == dict(enumerate(expected))
    for row in bpe.decode(encoded).collect():
        assert row.text == model.decode(expected[row.doc_id], skip_special_tokens=False)


def test_decoding_replaces_broken_bytes(spark):
    model = library("byte_bpe_50k.json")
    ids = model.encode("日本", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(rows).collect()} == {
        1: model.decode(ids[:1], skip_special_tokens=False), 2: "", 3: ""}


def test_packing_is_whole_and_gapless(spark, texts):
    model = library("word_bpe_49k.json")
    docs = documents(spark, texts).repartition(3)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in packing.pack(docs).collect():
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append(row)
    assert len(pieces) == len(texts)
    for doc, rows in pieces.items():
        ids = model.encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        at = 0
        for row in sorted(rows, key=lambda r: r.start):
            assert row.start == at and row.doc_tokens == len(ids)
            at += row.length
            part = ids[row.start:at]
            assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for row in sorted(rows, key=lambda r: r.offset):
            assert row.offset == at and row.length > 0
            at += row.length
        assert at == 4096 or at & (at - 1) == 0


def test_sum_of_squares_choice():
    rows = []
    packer = packing.Packer(8, 100, 0, rows.append)
    def ids(n):
        return bytes(4 * n)
    for n in (5, 5, 3):  # 3 completes a window, which takes one of the two alike ones away
        packer.add(n, ids(n))
    assert [r[0] for r in rows] == [5, 3] and packer.count[5] == 1
    packer.add(2, ids(2))  # beside a window at 5, a new level costs 1; 5 + 2 costs nothing more
    assert packer.count[7] == 1 and packer.count[5] == 0
    packer.add(20, ids(20))  # two whole windows at once
    assert [r[2] for r in rows[2:]] == [8, 8] and packer.open == 2


def test_bounded_open_windows():
    rows, rng = [], random.Random(2)
    packer = packing.Packer(64, 4, 0, rows.append)
    total = 0
    for i in range(500):
        n = rng.choice([33, 35, 40, 7])
        total += n
        packer.add(i, bytes(4 * n))
        assert packer.open <= 5
    packer.end()
    filled = defaultdict(int)
    for row in rows:
        filled[row[5]] += row[2]
    assert sum(filled.values()) == total
    assert sum(n != 64 for n in filled.values()) <= 6 and all(n & (n - 1) == 0 for n in filled.values())


@pytest.mark.parametrize("run", [token_count.token_counts, bpe.round_trip, packing.pack])
def test_odd_and_empty_tables(odd, run):
    rows = run(odd).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert sum(r.doc_id == 4 for r in rows) == 2
    assert run(odd.limit(0)).count() == 0


def test_words_of_letters_skip_the_steps_they_do_not_need(monkeypatch):
    """The same ids as the library's for every Latin letter, in long and short words, without a call of its whole way."""
    words = packing.WordIds(packing.vocabulary("word_bpe_49k.json"))
    letters = [chr(i) for i in range(0x180) if chr(i).isalpha()]
    texts = letters + [f"x{c}{c}on{c}" for c in letters] + ["straßenbahn", "œuvre", "the", "a" * 300]
    expected = [words.whole(t) for t in texts if "\u0130" not in t]
    monkeypatch.setattr(words, "whole", None)
    assert [words(t) for t in texts if "\u0130" not in t] == expected
