"""Token counts by heap-and-linked-list byte-pair merging (operator 7).

A document's count is its initial symbols minus the merges done; no token identifiers are made. The vocabulary is a
piece model whose scores give the merge order. A text is cut where no piece can reach across, so equal segments are
merged once per task and remembered.

NULL and empty texts have 0 tokens; a NULL ``doc_id`` stays NULL; repeated rows give repeated rows; further columns
are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from spendlens.llm.common import Memo, columns, map_batches, vocabulary
from spendlens.llm.merging import merge

SPACE = "▁"
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class PieceCounter:
    """Counts tokens of texts with a piece model of merges with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.pieces = set(scores)
        self.ranks = {(p[:k], p[k:]): (order[score], p) for p, score in scores.items() for k in range(1, len(p))
                      if (k == 1 or p[:k] in scores) and (k == len(p) - 1 or p[k:] in scores)}
        self.segments = self.cuts()
        self.memo = Memo(self.count_segment)

    def cuts(self) -> re.Pattern:
        """Segments that no piece reaches beyond: where no piece has two such neighbours, a text can be cut.

        Blanks start segments, and letters part from other characters, as far as the pieces allow both.
        """
        pairs = {(a, b) for p in self.pieces for a, b in zip(p, p[1:])}
        if any(a != SPACE and b == SPACE for a, b in pairs):
            return re.compile(".+", re.DOTALL)
        inner = {(a, b) for a, b in pairs if a != SPACE}
        word = re.compile(r"[^\W\d_]").match
        mixed = {a if word(a) else b for a, b in inner if bool(word(a)) != bool(word(b))}
        letters = f"[^\\W\\d_{re.escape(''.join(sorted(mixed)))}]"
        word = re.compile(letters).match
        if any(bool(word(a)) != bool(word(b)) for a, b in inner):
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        others = f"(?:[^\\w{SPACE}]|{letters.replace('^', '', 1).replace('W', 'd', 1)})"
        return re.compile(f"{SPACE}*(?:{letters}+|{others}+)|{SPACE}+")

    def count_segment(self, segment: str) -> int:
        pieces = self.pieces
        if len(segment) == 1:
            return 1 if segment in pieces else len(segment.encode())
        spare = sum([len(c.encode()) - 1 for c in segment if c not in pieces])  # such a symbol becomes bytes
        return len(merge(segment, self.ranks)) + spare

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        return sum(map(self.memo.__getitem__, self.segments.findall(marked)))


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(documents: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row of ``documents``."""

    def count(batch: pa.RecordBatch) -> list:
        count_one = counter(vocabulary(model)).count
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [count_one(t) for t in texts]
        return [batch.column(0), [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]]

    return map_batches(columns(documents, "doc_id", "text"), count, SCHEMA)
