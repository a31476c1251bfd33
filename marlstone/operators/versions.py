"""Picking the newest version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.sized import fits
from marlstone.session import materialize


def newest(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the one largest by ``order`` (nulls lowest); repeated rows count once.

    A ``max`` of structs, so a key that holds a third of all rows is combined on the map side instead of being
    sorted in one task. Ties in ``order`` are broken by a hash of the row, then by nothing: equal rows are equal.
    Null keys form a key of their own. An empty table gives an empty table.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    rank = F.struct(*[F.col(f"`{c}`") for c in (order or [])], F.xxhash64(*[F.col(f"`{c}`") for c in rest]))
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank)
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*").select(*df.columns)


def newest_of_few(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """As ``newest``, for wide tables of which few keys have several versions: the keys are counted first, and only the rows of
    repeated ones are shuffled. If more keys are repeated than may be broadcast, it is ``newest``."""
    rest = [c for c in df.columns if c not in keys]
    repeated = materialize(df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > 1).select(*[F.col(k).alias(f"__{k}") for k in keys]), "repeated")
    if not rest or not fits(repeated):
        return newest(df, keys, order)
    same = [df[k].eqNullSafe(repeated[f"__{k}"]) for k in keys]
    several = newest(df.join(F.broadcast(repeated), same, "left_semi"), keys, order)
    return df.join(F.broadcast(repeated), same, "left_anti").unionByName(several)
