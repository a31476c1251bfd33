"""Near-duplicate records by a chosen-path set similarity join.

Each record is a set of token hashes, embedded as ``SLOTS`` minwise tokens. Independent trees branch the records
recursively: the root of a tree sends a record to the child named by its minwise token in one slot; a node with more
than ``NODE`` records chooses ``BRANCH`` slots by a hash of its path and sends each of its records to the children named
by their tokens there. Pairs inside a small node are compared by a 128-bit sketch of the minwise tokens, and the pairs
left over by their whole token sets. A node that does not shrink any more holds records that agree everywhere; it is
compared in blocks of ``BLOCK`` records as matrices, so no pair is lost and no task holds a whole node.

Equal sets are joined first: only one representative of a class enters the trees.

At similarity s a pair meets at the root of a tree with probability s, and shares each of ``BRANCH`` children with
probability s; BRANCH is 1 / s at s = 0.5, which keeps the rows of a level from growing. With 8 trees the expected recall is
0.996 at s = 0.5 without a level of branching and 0.976, 0.945 and 0.908 with one, two and three; at 0.6 it is 0.999 without
and 0.996 with one, at 0.8 above 0.9999. Where so many records need so many levels that it would be under ``RECALL`` for pairs
just at the threshold, more trees are grown.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.sized import connected_components, sized
from marlstone.operators.versions import newest
from marlstone.session import materialize

SLOTS, TREES, BRANCH, NODE, DEPTH = 32, 8, 2, 32, 24
#: Expected share of pairs just at the threshold that are to be found, and records of a block of a node that does not shrink.
RECALL, BLOCK = 0.9, 2048
#: Least matching nibbles of 32 in two sketches, as a share of what the threshold predicts.
SKETCH_SHARE = 0.55
WORDS, SIMILARITY = 5, 0.8
_WORD = re.compile(r"[^\W_]+")
_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, count, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


_MUL, _ADD = _multipliers(SLOTS)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (uint32) of non-empty sets of uint64, one row per set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), SLOTS), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(SLOTS):
            x = flat * _MUL[k] + _ADD[k]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            out[:, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts)
    return out


@dataclass
class WordShingles:
    """Sets of all sequences of ``words`` consecutive words; texts of fewer than ``least`` words take no part."""

    words: int = WORDS
    least: int = WORDS

    def __call__(self, texts: list[str | None], owners: list[str | None]) -> list[np.ndarray | None]:
        memory: dict[str, int] = {}
        out: list[np.ndarray | None] = []
        for text in texts:
            found = _WORD.findall(text.lower()) if text else []
            if len(found) < max(self.least, self.words):
                out.append(None)
                continue
            if len(memory) > 500_000:
                memory.clear()
            for w in found:
                if w not in memory:
                    raw = w.encode()
                    memory[w] = zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)
            h = np.array([memory[w] for w in found], np.uint64)
            n = len(h) - self.words + 1
            x = np.zeros(n, np.uint64)
            for k in range(self.words):
                with np.errstate(over="ignore"):
                    x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
            out.append(np.unique(x))
        return out


@dataclass
class NameGrams:
    """Sets of character sequences of a file's name (last part of a path, without its last extension, lower-cased,
    letters and digits only), kept apart by owner."""

    size: int = 3

    def __call__(self, paths: list[str | None], owners: list[str | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        for path, owner in zip(paths, owners):
            name = (path or "").rpartition("/")[2]
            name = name.rpartition(".")[0] or name if "." in name else name
            name = "".join(_WORD.findall(name.lower()))
            if len(name) < self.size or owner is None:
                out.append(None)
                continue
            salt = zlib.crc32(owner.encode())
            grams = {name[i : i + self.size].encode() for i in range(len(name) - self.size + 1)}
            x = np.array([zlib.crc32(g, salt) << 32 | zlib.crc32(g + b"\0", salt) for g in grams], np.uint64)
            out.append(np.unique(_mix(x)))
        return out


def token_sets(df: DataFrame, record: str, text: str, make: Callable, owner: str | None = None) -> DataFrame:
    """(id, twin, sig, tokens) of the records that have a set: ``twin`` names records with equal sets, ``sig`` holds the
    minwise tokens and ``tokens`` the hashed set. Null ids and texts too short for a set give no row."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = make(part.column(1).to_pylist(), part.column(2).to_pylist())
            rows = [i for i, s in enumerate(sets) if s is not None]
            if not rows:
                continue
            kept = [sets[i] for i in rows]
            with np.errstate(over="ignore"):
                starts = np.cumsum([0, *(len(s) for s in kept)])[:-1]
                flat = np.concatenate(kept)
                twin = np.add.reduceat(_mix(flat * np.uint64(0xD6E8FEB86659FD93)), starts) ^ np.bitwise_xor.reduceat(_mix(flat), starts)
            sig = _signatures(kept).view(np.int32)
            small = (flat >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows)),
                    pa.array(twin.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SLOTS), pa.array(sig.ravel())),
                    pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(small)),
                ],
                names=["id", "twin", "sig", "tokens"],
            )

    source = df.select(F.col(f"`{record}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"), (F.col(f"`{owner}`") if owner else F.lit("")).alias("o"))
    return source.filter("id IS NOT NULL AND t IS NOT NULL").mapInArrow(batches, "id long, twin long, sig array<int>, tokens array<int>")


def _sketch(part: int) -> Column:
    """16 nibbles of the minwise tokens of half the slots."""
    whole = F.lit(0).cast("long")
    for k in range(16):
        whole = whole.bitwiseOR(F.shiftleft(F.col("sig")[part * 16 + k].bitwiseAND(15).cast("long"), 4 * k))
    return whole.alias(f"s{part}")


def _differing(a: Column, b: Column) -> Column:
    """Nibbles in which two halves of a sketch differ."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def _branch(rows: DataFrame) -> DataFrame:
    """Children of the records of large nodes (id, sig, path): slots chosen by the node, named by the records' tokens
    there. Carries the sketch instead of the tokens."""
    slots = [F.pmod(F.xxhash64("path", F.lit(j)), F.lit(SLOTS)).cast("int") for j in range(BRANCH)]
    children = F.array(*[F.xxhash64("path", s, F.col("sig")[s]) for s in slots])
    return rows.select("id", _sketch(0), _sketch(1), F.explode(F.array_distinct(children)).alias("path"))


def _pairs_in(nodes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs of small nodes whose sketches agree enough."""
    least = int(SKETCH_SHARE * 32 * (threshold + (1 - threshold) / 16))
    listed = nodes.groupBy(*keys).agg(F.collect_list(F.struct("id", "s0", "s1")).alias("all")).filter(F.size("all") > 1)
    pairs = listed.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).filter("a.id < b.id")
    return pairs.filter(_differing(F.col("a.s0"), F.col("b.s0")) + _differing(F.col("a.s1"), F.col("b.s1")) <= 32 - least).select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b")
    )


def expected_recall(left: list[float], trees: int, threshold: float) -> float:
    """Share of the pairs at the threshold that ``trees`` trees find, ``left[d]`` being the share of records that are still in large
    nodes after ``d`` + 1 levels."""
    q, out, here = 1.0, 0.0, 1.0
    for after in [*left, 0.0]:
        out += (here - after) * (1 - (1 - threshold * q) ** trees)
        q, here = 1 - (1 - threshold * q) ** BRANCH, after
    return out


def trees_for(left: list[float], threshold: float) -> int:
    """Trees that find a share of ``RECALL`` of the pairs at the threshold, at most one a slot."""
    return next((t for t in range(1, SLOTS) if expected_recall(left, t, threshold) >= RECALL), SLOTS)


def _pairs_across(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of large nodes (path, n, id, s0, s1) whose sketches agree enough, block against block."""
    least = int(SKETCH_SHARE * 32 * (threshold + (1 - threshold) / 16))
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("path", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "s0", "s1")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        own, ids = group.column("own").to_numpy(), group.column("id").to_numpy()
        # one byte a nibble, so that equal nibbles are counted by comparing
        raw = np.stack([group.column("s0").to_numpy(), group.column("s1").to_numpy()], 1).view(np.uint8)
        nibbles = np.concatenate([raw & 15, raw >> 4], 1)
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        left = np.flatnonzero(own == x)
        right = left if x == y else np.flatnonzero(own == y)
        found = []
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            alike = np.zeros((len(some), len(right)), np.uint8)
            for k in range(32):
                alike += nibbles[some, k][:, None] == nibbles[right, k][None, :]
            i, j = np.nonzero(alike >= least)
            a, b = ids[some[i]], ids[right[j]]
            keep = a < b if x == y else a != b
            found.append(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]]))
        out = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return pa.table([out[0], out[1]], schema=schema)

    return rows.groupBy("path", "x", "y").applyInArrow(compare, "a long, b long")


def _grow(sets: DataFrame, threshold: float, first: int, trees: int, depth: int) -> tuple[DataFrame, list[float]]:
    """Pairs that meet in the trees from ``first`` on, and after each level the share of records that are in large nodes."""
    # 11 is no divisor of 32, so consecutive trees begin at different slots
    roots = F.array(*[F.xxhash64(F.lit(t), F.col("sig")[t * 11 % SLOTS]) for t in range(first, first + trees)])
    level = sets.select("id", F.explode(roots).alias("path"), _sketch(0), _sketch(1))
    found: list[DataFrame] = []
    stubborn = None
    most: list[int] = []
    left: list[float] = []
    size = sets.count() * trees
    for d in range(depth):
        counts = level.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > NODE)
        large = sized(counts, "nodes")
        top, held = large.agg(F.max("n"), F.sum("n")).first()
        if top is None:
            found.append(level.select("path", "id", "s0", "s1"))
            break
        rows = level.join(large, "path", "left")
        found.append(rows.filter("n IS NULL").select("path", "id", "s0", "s1"))
        rows = rows.filter("n IS NOT NULL")
        most.append(top)
        left.append((left[-1] if left else 1.0) * min(1.0, held / size))
        size = held * BRANCH
        if d == depth - 1 or (len(most) > 2 and top >= most[-3]):
            stubborn = _pairs_across(rows, threshold)
            break
        if d == 0:
            with_tokens = sets.select("id", "sig", F.explode(roots).alias("path")).join(large, "path")
        else:  # few records are left in large nodes; only their tokens are moved
            active = sized(rows.select("id").distinct(), "active")
            with_tokens = rows.select("id", "path").join(sets.select("id", "sig").join(active, "id", "left_semi"), "id")
        level = materialize(_branch(with_tokens), "level")
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    pairs = _pairs_in(nodes, ["path"], threshold)
    return pairs if stubborn is None else pairs.unionByName(stubborn), left


def candidate_pairs(sets: DataFrame, threshold: float, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Distinct pairs (a < b) of ids that meet in a small node and whose sketches agree.

    A level below the roots holds only the records of large nodes and is written once. Branching ends when no node is
    large, or when the largest has not shrunk over two levels, or at ``depth``; what is large then is compared in
    blocks. If many records take so many levels that ``RECALL`` calls for more trees than ``trees``, those are grown too.
    """
    if not 0 < trees <= SLOTS:
        raise ValueError(f"1 to {SLOTS} trees")
    pairs, left = _grow(sets, threshold, 0, trees, depth)
    needed = trees_for(left, threshold)
    if needed > trees:
        pairs = pairs.unionByName(_grow(sets, threshold, trees, needed - trees, depth)[0])
    return pairs.distinct()


def similar_sets(sets: DataFrame, threshold: float = SIMILARITY, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives, and the membership of every record.

    ``sets`` comes from ``token_sets`` of a table with one row per id. Returns ``(links, members)``: links (a, b, similarity) with a < b representatives whose sets overlap (shared /
    all distinct) by ``threshold`` or more, and members (id, rep) with one row per record, rep being the smallest id
    among the records with an equal set. Expected misses are given in the module text; no false link is returned.
    """
    sets = materialize(sets, "sets")
    classes = sets.groupBy("twin").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("twin", "rep")
    classes = sized(classes, "twins")
    members = sets.select("id", "twin").join(classes, "twin", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    heads = sets.join(classes, "twin", "left").filter("rep IS NULL OR rep = id").select("id", "sig", "tokens")
    pairs = materialize(candidate_pairs(heads, threshold, trees), "pairs")
    needed = sized(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    tokens = heads.select("id", "tokens").join(needed, "id", "left_semi")
    both = pairs.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    both = both.select("a", "b", (shared / (F.size("ta") + F.size("tb") - shared)).alias("similarity"))
    return both.filter(F.col("similarity") >= threshold), members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of records (id_a < id_b) that the links and classes stand for. The result is as large as the pairs
    are many; prefer links and members."""
    a, b = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    several = members.groupBy("rep").count().filter("count > 1").select("rep")
    inside = members.join(several, "rep", "left_semi")
    inside = inside.select("rep", F.col("id").alias("id_a")).join(inside.select("rep", F.col("id").alias("id_b")), "rep").filter("id_a < id_b")
    return across.unionByName(inside.select("id_a", "id_b"))


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group_id, links): the connected group of every record, named by its smallest id, and the number of
    different texts its text is linked to. A record without a link is a group of its own class."""
    component = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    named = members.join(component.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return named.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def every_record(ids: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows of ``groups`` for all of ``ids`` (id): records without a set are groups of their own."""
    all_ids = ids.filter("id IS NOT NULL").distinct()
    return all_ids.join(grouped, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_duplicates(df: DataFrame, record: str, text: str, words: int = WORDS, threshold: float = SIMILARITY, least: int | None = None) -> DataFrame:
    """(id, group_id, links), one row per record of ``df``.

    Texts of fewer than ``least`` words (default: ``words``), empty and null ones have no set and are groups of their own;
    equal texts share a group; rows repeated under one id count once (of several texts under an id one is taken: pick
    versions before); null ids give no row; other columns do not matter. An empty table gives an empty table.
    """
    rows = newest(df.select(F.col(f"`{record}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")), ["id"])
    sets = token_sets(rows, "id", "text", WordShingles(words, least or words))
    return every_record(rows.select("id"), groups(*similar_sets(sets, threshold)))
