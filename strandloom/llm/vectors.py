"""Packed blocks of vectors shared by the search and the near-duplicate join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is not null and all of its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def narrowest(matrix: np.ndarray) -> np.ndarray:
    """Integers in as few bytes as hold them."""
    most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)) - 1)
    return matrix.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def pack(rows: DataFrame, keys: list[str], values: str, extra: list[str]) -> DataFrame:
    """One row for each group of keys, with the group's integer vectors as one binary matrix.

    extra columns (long) are packed beside it in the same row order. Groups are
    bounded by the caller.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        matrix = narrowest(np.asarray(group[values].tolist(), dtype="<i8"))
        out = {k: [group[k].iloc[0]] for k in keys}
        out |= {c: [group[c].to_numpy(dtype="<i8").tobytes()] for c in extra}
        return pd.DataFrame(out | {values: [matrix.tobytes()]})

    schema = ", ".join([*(f"{k} {dict(rows.dtypes)[k]}" for k in keys), *(f"{c} binary" for c in extra), f"{values} binary"])
    return rows.select(*keys, *extra, values).groupBy(*keys).applyInPandas(run, schema)


def matrix(packed: bytes, width: int, rows: int) -> np.ndarray:
    """The integers that pack() has packed."""
    kind = f"<i{len(packed) // (rows * width)}" if rows and width else "<i2"
    return np.frombuffer(packed, dtype=kind).reshape(rows, width)


def ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<i8")
