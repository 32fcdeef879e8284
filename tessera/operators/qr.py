"""Tall-skinny QR: the triangular factor of a table of columns, of any number of rows.

Each partition folds its batches of rows into one Householder triangle, and triangles are stacked and factored again in a
tree of shuffles, each a matrix the size of the columns. The squares of the columns are never formed, so a design keeps the
digits that its condition leaves, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that the partitions' triangles meet in, level by level; the driver stacks those of the last.
LEVELS = (1024, 32)
_PART = "by bigint, part bigint, triangle binary"


def stacked(triangles: Sequence[np.ndarray], width: int) -> np.ndarray:
    """The triangle of matrices one below the other."""
    return np.linalg.qr(np.vstack([*triangles, np.zeros((width, width))]), "r")


def _folded(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, np.ndarray] = {}
        for batch in batches:
            by, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = np.column_stack(columns)
            for k in np.unique(by).tolist():
                found[k] = stacked([found.get(k, np.zeros((0, width))), rows[by == k]], width)
        if found:
            part = [TaskContext.get().partitionId()] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(part, pa.int64()), pa.array([t.tobytes() for t in found.values()], pa.binary())], ["by", "part", "triangle"])

    return run


def _merged(width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        triangle = stacked([np.frombuffer(t.as_py()).reshape(width, width) for t in table.column("triangle")], width)
        return pa.table({"by": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "triangle": [triangle.tobytes()]})

    return run


def triangle(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """The upper triangle R of the matrix whose columns these are (finite numbers): R'R are its sums of products."""
    found = triangles(df, columns, F.lit(0))
    return found.get(0, np.zeros((len(columns), len(columns))))


def triangles(df: DataFrame, columns: Sequence[Column], by: Column) -> dict[int, np.ndarray]:
    """The triangle of the rows of every value of ``by`` (few whole numbers, as folds are), all in the same passes."""
    width = len(columns)
    parts = df.select(by.cast("bigint").alias("by"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(_folded(width), _PART)
    for groups in LEVELS:
        parts = parts.groupBy("by", F.pmod("part", F.lit(groups)).alias("group")).applyInArrow(_merged(width), _PART)
    found: dict[int, list[np.ndarray]] = {}
    for r in parts.collect():  # one row a group
        found.setdefault(r["by"], []).append(np.frombuffer(r.triangle).reshape(width, width))
    return {k: stacked(t, width) for k, t in sorted(found.items())}
