"""Chunking of texts and vector arithmetic."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, functions as F

# Chunk size, overlap and separators, coarsest first.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", " ", "")


def _parts(text: str, separator: str) -> list[str]:
    """Pieces of the text, a separator staying at the head of the piece it opens."""
    if not separator:
        return list(text)
    first, *others = text.split(separator)
    return ([first] if first else []) + [separator + part for part in others]


def _pack(parts: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring parts up to ``size``; a chunk starts with up to ``overlap`` characters of the last one."""
    chunks, window, length = [], deque(), 0
    for part in parts:
        if window and length + len(part) > size:
            chunks.append("".join(window).strip())
            while window and (length > overlap or length + len(part) > size):
                length -= len(window.popleft())
        window.append(part)
        length += len(part)
    chunks.append("".join(window).strip())
    return [chunk for chunk in chunks if chunk]


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the coarsest separator that occurs; pieces that are still too long are cut at the next one."""
    level = next(i for i, s in enumerate(separators) if not s or s in text)
    finer, chunks, fitting = separators[level + 1:], [], []
    for part in _parts(text, separators[level]):
        if len(part) < size or not finer:
            fitting.append(part)
            continue
        chunks += _pack(fitting, size, overlap) + split_text(part, size, overlap, finer)
        fitting = []
    return chunks + _pack(fitting, size, overlap)


def chunks_of(text: str | Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunks of a text column.

    Not by Arrow: an Arrow batch holds 10,000 texts however long, with their chunks once as objects and once as a column.
    Plain functions get their rows by the hundred, so a worker's memory does not grow with the table or its files.
    """
    return F.udf(lambda t: split_text(t, size, overlap) if t else [], "array<string>", useArrow=False)(text)


def dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine_similarity(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit_vector(v) -> Column:
    """The vector scaled to length 1; a zero vector stays zero."""
    c = F.col(v) if isinstance(v, str) else v
    length = norm(c)
    return F.transform(c, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))
