"""Packing of token sequences by the sum-of-squares rule (operator 9).

Each task packs its own documents online. A document's tokens fill whole windows first; the rest goes to the fill level
that leaves the smallest sum, over all levels, of the squared number of windows at that level. The numbers stand in a
level array, so a choice costs one pass over it however many windows are open. When many windows are open, and at the
end, the emptiest ones are cut up to fill the gaps of the fullest, so memory is bounded and at most one window per task
stays short; it leaves as sequences whose lengths are powers of two, which need no padding.

No rows are shuffled. Sequence numbers start with the task's number; a task that runs again packs alike.
NULL texts count as empty: one token, the end mark. A NULL ``doc_id`` stays NULL. Repeated rows are packed as often as
they occur. Further columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spendlens.llm.bpe import byte_symbols
from spendlens.llm.common import (BEYOND_LATIN, LATIN_BLANKS, LATIN_LETTERS, LATIN_NUMBERS, Memo, columns, to_arrow,
                                  vocabulary)

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "`offset` bigint")

#: The word pattern of the lower-case vocabulary (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_WORDS = (WORDS.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_BLANKS}{LATIN_LETTERS}{LATIN_NUMBERS}]")
               .replace(r"[\p{L}]", f"[{LATIN_LETTERS}]").replace(r"[\p{N}]", f"[{LATIN_NUMBERS}]"))


#: How a byte-level vocabulary writes the bytes, read as Latin-1.
BYTE_SYMBOLS = dict(enumerate(byte_symbols()))


class WordIds:
    """Token ids of texts as little-endian 32-bit integers, from the tokenizer library word by word.

    Words do not influence one another, so each is encoded once per task. Those of letters, which need no normalizing and
    no splitting, go to the library's model without its other steps. Texts with characters beyond the Latin
    blocks, or with something like a special token, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = re.compile(LATIN_WORDS)
        self.model = self.library.model
        self.memo = Memo(self.word)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if not word.isalpha():
            return self.whole(word)
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_SYMBOLS)
        return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if "<|" in text or BEYOND_LATIN.search(text):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, self.words.findall(text.lower())))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """Sum-of-squares packing of one task's documents; ``emit`` gets the rows of finished sequences."""

    def __init__(self, size: int, most_open: int, first_sequence: int, emit: Callable[[tuple], None]):
        self.size, self.most_open, self.next, self.emit = size, most_open, first_sequence, emit
        self.count = np.zeros(size + 1, np.int64)  # windows at each fill level
        self.at: list[list[list]] = [[] for _ in range(size + 1)]  # the windows themselves
        self.open = 0

    def close(self, window: list) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.emit((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def level(self, length: int) -> int:
        """The fill level to add ``length`` tokens to, 0 for a new window; the fullest of equally good ones."""
        n, size = self.count, self.size
        last = size - length
        new = 2 * n[length] + 1 if length < size else 0
        if last < 1:
            return 0
        change = 1 - 2 * n[1:last + 1]
        change[:-1] += 2 * n[1 + length:size] + 1
        change[n[1:last + 1] == 0] = np.iinfo(np.int64).max
        k = last - 1 - int(np.argmin(change[::-1]))
        return k + 1 if change[k] <= new else 0

    def put(self, window: list, level: int) -> None:
        if level == self.size:
            self.close(window)
        else:
            self.at[level].append(window)
            self.count[level] += 1
            self.open += 1

    def take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def add(self, doc: int | None, ids: bytes) -> None:
        total, size = len(ids) // 4, self.size
        whole = total - total % size
        for start in range(0, whole, size):
            self.close([(doc, start, ids[4 * start:4 * (start + size)], total)])
        if rest := total - whole:
            level = self.level(rest)
            window = self.take(level) if level else []
            window.append((doc, whole, ids[4 * whole:], total))
            self.put(window, level + rest)
        if self.open > self.most_open:
            self.fill_gaps()

    def fill_gaps(self) -> None:
        """Cuts the emptiest open windows into the gaps of the fullest until at most one is left open."""
        windows = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.at[level]]
        self.at = [[] for _ in self.at]
        self.count[:] = 0
        self.open = 0
        last = len(windows) - 1
        for k, (level, window) in enumerate(windows):
            if k > last:
                break
            while level < self.size and last > k:
                left, donor = windows[last]
                doc, start, ids, total = donor.pop()
                room = 4 * (self.size - level)
                window.append((doc, start, ids[:room], total))
                level += min(len(ids), room) // 4
                if len(ids) > room:
                    donor.append((doc, start + room // 4, ids[room:], total))
                windows[last] = (left - min(len(ids), room) // 4, donor)
                if not donor:
                    last -= 1
            self.put(window, level)

    def end(self) -> None:
        self.fill_gaps()
        for level in range(1, self.size):
            for window in self.at[level]:
                part = 1 << level.bit_length()
                while window:
                    part >>= 1
                    if not part & level:
                        continue
                    piece, room = [], 4 * part
                    while room:
                        doc, start, ids, total = window.pop(0)
                        piece.append((doc, start, ids[:room], total))
                        if len(ids) > room:
                            window.insert(0, (doc, start + room // 4, ids[room:], total))
                        room -= min(len(ids), room)
                    self.close(piece)


def pack(documents: DataFrame, model: str = "word_bpe_49k.json", size: int = 4096, end: int = 2,
         most_open: int = 256) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence of at most ``size`` ids.

    ``end`` is the id put behind every document; at most ``most_open`` windows are open in a task at a time.
    """
    docs = columns(documents, "doc_id", "text")
    schema = to_arrow(documents.sparkSession, SCHEMA)
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(vocabulary(model))
        rows: list[tuple] = []

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return batch

        packer = Packer(size, most_open, TaskContext.get().partitionId() << 33, rows.append)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc, ids(text or "") + mark)
                if len(rows) >= 10_000:
                    yield ready()
        packer.end()
        if rows:
            yield ready()

    return docs.mapInArrow(run, SCHEMA)
