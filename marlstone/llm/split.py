"""Splitting of oversized items at natural boundaries, by pointer doubling.

Every natural boundary of an item (paragraph, line, fence, table-row or sentence end) is joined to its farthest legal
successor: the last boundary whose piece, with the overlap in front, still fits the limit. The successor tables are
then squared again and again; after log2(pieces) rounds the boundaries reached from the start are all greedy cuts.
An item's boundaries come from its own row, so the join is a gather inside the Arrow batch and nothing is shuffled;
one table serves all items of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n(?:.*?\n)??(?: {0,3}\1[`~]*[ \t]*(?:\n|\Z)|\Z)", re.M | re.S)
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'’”»)\]]*(?:[^\S\n]+|(?<=[。！？]))")
_SPACE = re.compile(r"\s+")


def _ends(pattern: re.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted natural boundaries (the end of the text among them), and sorted word boundaries for want of those.

    Inside a code fence only line ends are natural.
    """
    sentence = _ends(_SENTENCE, text)
    fences = [m.span() for m in _FENCE.finditer(text)] if "```" in text or "~~~" in text else []
    if fences and sentence.size:
        starts, stops = np.array(fences, np.int64).T
        at = np.searchsorted(starts, sentence, "left") - 1
        sentence = sentence[(at < 0) | (sentence > stops[np.maximum(at, 0)])]
    natural = np.unique(np.concatenate([_ends(_LINE, text), sentence, [len(text)]]))
    return natural[natural > 0], np.unique(_ends(_SPACE, text))


def _hard(points: np.ndarray, first: int, step: int) -> np.ndarray:
    """Places to cut where no boundary is in reach: at every step inside the gaps that are longer than a step."""
    left = np.concatenate([[first], points[points > first]])
    gap = np.diff(left)
    wide = np.flatnonzero(gap > step)
    if not wide.size:
        return np.empty(0, np.int64)
    return np.concatenate([np.arange(left[k] + step, left[k + 1], step) for k in wide])


def _successors(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of an item's nodes (0 first) and, for each, the index of its farthest legal successor."""
    step, size = limit - overlap, len(text)
    natural, words = boundaries(text)
    points = np.union1d(natural, words)
    hard = [_hard(points, int(points[0]), step)]
    legal = points[points > overlap]
    if legal[0] > limit:  # the first piece has no overlap in front of it
        hard += [np.array([limit]), _hard(legal, limit, step)]
    nodes = np.unique(np.concatenate([[0], points, *hard]))
    reach = np.minimum(nodes + step, size)
    reach[0] = min(limit, size)
    floor = nodes.copy()
    floor[0] = overlap
    best = np.full(len(nodes), -1, np.int64)
    for tier in (natural, words):
        last = np.searchsorted(tier, reach, "right") - 1
        found = np.where(last >= 0, tier[np.maximum(last, 0)] if tier.size else -1, -1)
        best = np.where((best < 0) & (found > floor), found, best)
    best = np.where(best < 0, reach, best)
    best[-1] = size
    # a node that no walk from 0 can reach may lack its hard cut in the table; any later node will do for it
    return nodes, np.minimum(np.searchsorted(nodes, best), len(nodes) - 1)


def cut_batch(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int]]]:
    """Start and end of every piece of every text; a text within the limit is one piece, an empty text none."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    out: list[list[tuple[int, int]]] = [[(0, len(t))] if t else [] for t in texts]
    long = [i for i, t in enumerate(texts) if len(t) > limit]
    if not long:
        return out
    tables = [_successors(texts[i], limit, overlap) for i in long]
    base = np.cumsum([0, *(len(n) for n, _ in tables)])
    jump = np.concatenate([s + b for (_, s), b in zip(tables, base)])
    reached = np.zeros(base[-1], bool)
    reached[base[:-1]] = True
    while True:
        before = np.count_nonzero(reached)
        reached[jump[reached]] = True
        jump = jump[jump]
        if np.count_nonzero(reached) == before and reached[base[1:] - 1].all():
            break
    for k, i in enumerate(long):
        ends = tables[k][0][reached[base[k] : base[k + 1]]][1:].tolist()
        out[i] = [(0 if j == 0 else ends[j - 1] - overlap, e) for j, e in enumerate(ends)]
    return out


def cuts_of(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<start,end>> of the pieces. Only texts over the limit are sent to Python."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            found = cut_batch([t or "" for t in texts.to_pylist()], limit, overlap)
            yield pa.array([[{"start": a, "end": b} for a, b in x] for x in found], kind)

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    none = F.slice(whole, 1, 0)
    long = F.length(text) > limit
    return F.when(long, cut(F.when(long, text))).when(F.length(text) > 0, whole).otherwise(none)


def split_items(items: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: the columns of ``items`` without ``text``, then piece_index, piece_start, piece_end, piece.

    Pieces have at most ``limit`` characters (code points) and end at the farthest natural boundary in reach, else
    after white space, else at the limit; each starts exactly ``overlap`` characters before the end of the one
    before. Null and empty texts give no piece; repeated rows are split repeatedly; columns of ``items`` named like
    an output column are replaced.
    """
    new = {"piece_index", "piece_start", "piece_end", "piece"}
    kept = [c for c in items.columns if c != text and c not in new]

    @F.arrow_udf("array<struct<start:int,end:int,piece:string>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string())]))
        for column in batches:
            texts = [t or "" for t in column.to_pylist()]
            found = cut_batch(texts, limit, overlap)
            yield pa.array([[{"start": a, "end": b, "piece": t[a:b]} for a, b in x] for t, x in zip(texts, found)], kind)

    body = F.col(f"`{text}`")
    long = F.length(body) > limit
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(body).alias("end"), body.alias("piece")))
    pieces = F.when(long, cut(F.when(long, body))).when(F.length(body) > 0, whole)
    return (
        items.select(*[F.col(f"`{c}`") for c in kept], F.posexplode(pieces).alias("piece_index", "__piece"))
        .select(*[F.col(f"`{c}`") for c in kept], "piece_index", F.col("__piece.start").alias("piece_start"), F.col("__piece.end").alias("piece_end"), F.col("__piece.piece").alias("piece"))
    )
