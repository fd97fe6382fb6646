"""Byte-pair encoding and decoding (operator 10).

A text is cut into chunks by the vocabulary's pattern; each chunk's bytes are merged through a heap of merge ranks over
a doubly linked list, skipping stale entries. Decoding concatenates vocabulary strings. Equal chunks are encoded once
per task and remembered in a table of bounded size.

NULL texts count as empty: no tokens and the hash of no bytes. A NULL ``doc_id`` stays NULL, repeated rows give repeated
rows, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from spendlens.llm.common import (BEYOND_LATIN, LATIN_BLANKS, LATIN_LETTERS, LATIN_NUMBERS, Memo, columns, map_batches,
                                  vocabulary)
from spendlens.llm.merging import merge

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

#: The chunk pattern of byte-level vocabularies (fixed value).
CHUNKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_CHUNKS = (CHUNKS.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_BLANKS}{LATIN_LETTERS}{LATIN_NUMBERS}]")
                .replace(r"\p{L}", f"[{LATIN_LETTERS}]").replace(r"\p{N}", f"[{LATIN_NUMBERS}]")
                .replace(r"(?!\S)", f"(?![^{LATIN_BLANKS}])").replace(r"\s", f"[{LATIN_BLANKS}]"))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class ByteBpe:
    """Encodes and decodes with the vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        ids = model["vocab"]
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.first = [ids[s] for s in byte_symbols()]
        self.strings = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: token.encode() for token, i in self.special.items()}
        self.by_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.any_chunks, self.latin_chunks = regex.compile(CHUNKS), re.compile(LATIN_CHUNKS)
        self.memo = Memo(self.encode_chunk)

    def encode_chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Token ids as little-endian 32-bit integers, and the bytes that they decode to."""
        first, ranks = self.first, self.ranks
        ids = merge([first[b] for b in chunk.encode()], ranks)
        return struct.pack(f"<{len(ids)}I", *ids), self.joined(ids)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def coded(self, text: str) -> list[tuple[bytes, bytes]]:
        parts = self.by_special.split(text) if self.special else [text]
        found = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append((struct.pack("<I", self.special[part]), part.encode()))
            elif part:
                cut = self.any_chunks if BEYOND_LATIN.search(part) else self.latin_chunks
                found.extend(map(self.memo.__getitem__, cut.findall(part)))
        return found

    def encode(self, text: str) -> list[int]:
        packed = b"".join([ids for ids, _ in self.coded(text)])
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return self.joined(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(documents: DataFrame, model: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and the token ids of each text."""

    def code(batch: pa.RecordBatch) -> list:
        own = tokenizer(vocabulary(model))
        return [batch.column(0), [own.encode(t or "") for t in batch.column(1).to_pylist()]]

    return map_batches(columns(documents, "doc_id", "text"), code, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, model: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and the text of each list of token ids; NULL lists give the empty text."""

    def back(batch: pa.RecordBatch) -> list:
        own = tokenizer(vocabulary(model))
        return [batch.column(0), [own.decode(ids or []) for ids in batch.column(1).to_pylist()]]

    return map_batches(columns(tokens, "doc_id", "ids"), back, "doc_id bigint, text string")


def round_trip(documents: DataFrame, model: str = "byte_bpe_50k.json") -> DataFrame:
    """Number and hash of each text's token ids, and the hash of the text that they decode to."""

    def code(batch: pa.RecordBatch) -> list:
        own = tokenizer(vocabulary(model))
        n, ids, texts = [], [], []
        for text in batch.column(1).to_pylist():
            coded = own.coded(text or "")
            packed = b"".join([i for i, _ in coded])
            back = b"".join([b for _, b in coded]).decode("utf-8", "replace").encode()
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            texts.append(hashlib.sha256(back).hexdigest())
        return [batch.column(0), n, ids, texts]

    return map_batches(columns(documents, "doc_id", "text"), code, SCHEMA)
