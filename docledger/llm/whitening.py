"""Whitening of embeddings by a tiled covariance.

Pairs of dimensions are cut into tiles. Vectors are cut into column blocks, a row block's column blocks are shuffled
together, each tile multiplies the two that it needs, and products are summed by tile. Only the tiles, which do not grow
with the table, come to the driver, which assembles and decomposes the covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm._spark import Tables

SCALE = 256
TILE = 32  # dimensions
ROWS = 2048  # of a row block
SAFE = 1 << 62
DIGITS = 38


def integers(rows: DataFrame, vector: str, width: int | None = None) -> DataFrame:
    """Rows whose vector is there and finite, with x = floor(SCALE * component) of each, filled with 0 up to a width."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    if width is not None:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))
    return rows.filter(F.col(vector).isNotNull() & finite).withColumn("x", x)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Fit:
    """Number, exact sums and components of distinct vectors; small, and sent to tasks."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums, self.width = n, sums, len(sums)
        # a mean as a whole number and a fraction, so that centring loses nothing to large means
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray, at: slice = slice(None)) -> np.ndarray:
        whole, part = self.whole[at], self.part[at]
        near = np.abs(x.astype(np.float64)).max(initial=0) < SAFE and np.abs(whole.astype(np.float64)).max(initial=0) < SAFE
        return (x - whole if near else x.astype(np.float64) - whole) - part

    def decompose(self, covariance: np.ndarray, most: int) -> None:
        values, vectors = np.linalg.eigh(covariance)
        trace = float(np.trace(covariance))
        order = np.argsort(-values, kind="stable")[:most]
        vectors = vectors[:, order]
        largest = np.abs(vectors).argmax(axis=0)
        self.vectors = vectors * np.sign(vectors[largest, np.arange(len(order))])
        self.values = values[order]
        #: Components along which vectors do not differ, up to rounding, cannot be whitened.
        self.usable = self.values > max(trace, 0.0) * self.width * np.finfo(np.float64).eps
        self.explained = [v / trace if trace > 0 else None for v in self.values.tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Of each vector and usable component."""
        return self.centred(x) @ (self.vectors[:, self.usable] / np.sqrt(self.values[self.usable]))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum)^2, in whole numbers of any size."""
        most = max(int(abs(v)) for v in (x.min(initial=0), x.max(initial=0)))
        sums = np.array(self.sums, object)
        if max(most, *(abs(s) for s in self.sums)) * max(most, 1) * self.width < SAFE:
            small = sums.astype(np.int64)
            squares, products = (x * x).sum(axis=1).tolist(), (x @ small).tolist()
        else:
            big = x.astype(object)
            squares, products = (big * big).sum(axis=1).tolist(), big.dot(sums).tolist()
        rest = sum(s * s for s in self.sums)
        return [self.n * self.n * a - 2 * self.n * b + rest for a, b in zip(squares, products, strict=True)]


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of dimensions; each task adds up its own, and Spark those of the tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            x = matrix(batch.column(0), width)
            near = np.abs(x.astype(np.float64)).max(initial=0) * max(len(x), 1) < SAFE
            n, total = n + len(x), total + (x.sum(axis=0).astype(object) if near else x.astype(object).sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(DIGITS, 0))], names=["dim", "n", "total"])

    parts = fit.select("x").mapInArrow(partial, f"dim int, n long, total decimal({DIGITS},0)")
    rows = sorted(parts.groupBy("dim").agg(F.sum("n"), F.sum("total")).collect())
    return rows[0][1], [int(r[2]) for r in rows]


def covariance(fit: DataFrame, centre: Fit, tile: int = TILE) -> np.ndarray:
    """The covariance of centred vectors (divisor n), tile by tile."""
    width = centre.width

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = matrix(batch.column(0), width)
            for start in range(0, len(x), ROWS):
                rows = x[start : start + ROWS]
                small = rows.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= rows.min() and rows.max() <= np.iinfo(t).max))
                blocks = [np.ascontiguousarray(small[:, at : at + tile]).tobytes() for at in range(0, width, tile)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array([small.dtype.str] * len(blocks)), pa.array(blocks, pa.binary())], names=["row_block", "column_block", "kind", "data"])
                number += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        now, blocks = None, []
        for batch in batches:
            for row_block, i, kind, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if row_block != now:
                    now, blocks = row_block, []
                at = slice(i * tile, min((i + 1) * tile, width))
                blocks.append(centre.centred(np.frombuffer(data, kind).reshape(-1, at.stop - at.start).astype(np.int64), at))
                # column blocks come in order, so that each one meets those before it and itself
                for j, before in enumerate(blocks):
                    product = before.T @ blocks[i]
                    found[j, i] = found[j, i] + product if (j, i) in found else product
        yield from shown(found)

    def shown(found: dict) -> Iterator[pa.RecordBatch]:
        if found:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["i", "j", "part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, _, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                value = np.frombuffer(data)
                found[i, j] = found[i, j] + value if (i, j) in found else value
        yield from shown(found)

    tiles = "i int, j int, part int, data binary"
    blocks = fit.select("x").mapInArrow(cut, "row_block long, column_block int, kind string, data binary")
    products = blocks.repartition("row_block").sortWithinPartitions("row_block", "column_block").mapInArrow(multiply, tiles)
    totals = products.repartition("i", "j").sortWithinPartitions("i", "j", "part").mapInArrow(add, tiles)
    out = np.zeros((width, width))
    for i, j, _, data in totals.collect():
        rows, columns = slice(i * tile, min((i + 1) * tile, width)), slice(j * tile, min((j + 1) * tile, width))
        out[rows, columns] = np.frombuffer(data).reshape(rows.stop - rows.start, -1)
        out[columns, rows] = out[rows, columns].T
    return out / centre.n


def identity_error(fit: DataFrame, found: Fit) -> float | None:
    """By how much the covariance of the whitened vectors differs from the identity; each task's share is centred, and shares are merged."""
    k = int(found.usable.sum())
    if not k:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = None
        for batch in batches:
            if batch.num_rows:
                w = found.whitened(matrix(batch.column(0), found.width))
                mean = w.mean(axis=0)
                share = merged(share, (len(w), mean, (w - mean).T @ (w - mean)))
        if share is not None:
            yield pa.RecordBatch.from_arrays([pa.array([share[0]], pa.int64()), pa.array([share[1].tobytes()], pa.binary()), pa.array([share[2].tobytes()], pa.binary())], names=["n", "mean", "products"])

    whole = None
    for n, mean, products in fit.select("x").mapInArrow(partial, "n long, mean binary, products binary").collect():
        whole = merged(whole, (n, np.frombuffer(mean), np.frombuffer(products).reshape(k, k)))
    return float(np.abs(whole[2] / whole[0] - np.eye(k)).max())


def merged(one: tuple | None, other: tuple) -> tuple:
    """Number, mean and centred products of two sets together."""
    if one is None:
        return other
    (n, mean, products), (m, mean2, products2) = one, other
    gap = mean2 - mean
    return n + m, mean + gap * (m / (n + m)), products + products2 + np.outer(gap, gap) * (n * m / (n + m))


def whiten(rows: DataFrame, components: int = 4, tile: int = TILE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Vectors projected on the leading components of their covariance, scaled to unit variance.

    Rows without a vector, or with null or non-finite components, are left out. Components of vectors become whole numbers
    x = floor(256 * c); the covariance is that of all distinct x, each once, centred before it is multiplied. Returns for
    each row and component (from 1, by falling eigenvalue): the id, component, n (distinct vectors), deviation (sum over
    dimensions of (n * x - sum)^2, exact, decimal(38,0), null beyond), whitened, explained (the eigenvalue's share of the trace),
    identity_error (of all whitened distinct vectors). A component's sign makes its largest entry positive.

    Vectors shorter than the longest count as ending in zeros; with fewer dimensions than components there are as many
    components as dimensions. Where vectors do not differ along a component, whitened is null, and so is explained if they
    do not differ at all. Repeated rows and null ids get rows of their own. Without vectors there are no rows. Extra columns
    are not read. The driver holds a matrix of dimensions by dimensions, which does not grow with the table.
    """
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation decimal({DIGITS},0), whitened double, explained double, identity_error double"
    own = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    width = integers(own, "vector").agg(F.max(F.size("vector"))).first()[0]
    if not width:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    whole = integers(own, "vector", width).select("id", "x")
    tables = Tables(spark, "whitening")
    fit = tables.write(whole.select("x").distinct(), "fit")
    found = Fit(*sums(fit, width))
    found.decompose(covariance(fit, found, tile), components)
    error = identity_error(fit, found)
    tables.drop()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, usable = len(found.values), found.usable
        for batch in batches:
            if not batch.num_rows:
                continue
            x, times = matrix(batch.column(1), width), np.repeat(np.arange(batch.num_rows), count)
            values = np.full((len(x), count), np.nan)
            values[:, usable] = found.whitened(x)
            exact = [Decimal(d) if d < 10**DIGITS else None for d in found.deviations(x)]
            columns = [
                batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array([found.n] * len(times), pa.int64()),
                pa.array(exact, pa.decimal128(DIGITS, 0)).take(pa.array(times)), pa.array(values.ravel(), from_pandas=True), pa.array(found.explained * len(x), pa.float64()), pa.array([error] * len(times), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(project, out).withColumnRenamed("id", id_col)
