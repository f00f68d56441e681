"""Whitening of embeddings by principal components, with moments merged pairwise.

Each partition computes count, mean and centred scatter of its distinct vectors; two such moments merge by Chan's
formula (scatters add up, plus the outer product of the means' difference, weighted), in a tree of tasks, so the
driver gets one matrix of d x d and never a row. It takes the eigenvectors; a second pass over the fit list measures
how far the covariance of the whitened vectors is from the identity.

The distinct vectors are written once as parquet in the shared checkpoint folder, for both passes read the same
list, and deleted when the model is there. The model (d x 16 numbers for each length of vectors) goes to the tasks
with their function; whitening itself shuffles nothing.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.llm import common
from kinlight.plans.lineage import checkpoint_dir, remove_folder

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, scaled, count as this.
MOST = float(1 << 61)
COMPONENTS = 16
#: Share of the largest eigenvalue below which one is rounding: its direction holds no variance to divide by.
NO_VARIANCE = 1e-11
LOW_BITS = 30


@dataclass
class Moments:
    """Count, mean and centred scatter of vectors, and their exact sums as Python integers (none of real vectors)."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        sums = []
        if x.dtype == np.int64:
            high, low = x >> LOW_BITS, x & ((1 << LOW_BITS) - 1)
            sums = [(int(h) << LOW_BITS) + int(v) for h, v in zip(high.sum(0), low.sum(0), strict=True)]
            mean = np.array([s / len(x) for s in sums])
        else:
            mean = x.mean(0)
        centred = x - mean
        return cls(len(x), mean, centred.T @ centred, sums)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), scatter, [a + b for a, b in zip(self.sums, other.sums, strict=True)])


By = dict[int, Moments]


def merge(a: By, b: By) -> By:
    """Moments by length of the vectors."""
    return {d: a[d].merged(b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


@dataclass
class Model:
    """Whitening of vectors of one length: eigenvalues from the largest, unit directions as columns."""

    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray
    total: float
    identity_error: float = 0.0

    @classmethod
    def of(cls, moments: Moments, components: int) -> Model:
        values, vectors = np.linalg.eigh(moments.scatter / moments.n)
        values, vectors = values[::-1], vectors[:, ::-1]
        held = (values > values[:1].sum() * NO_VARIANCE) & (np.arange(len(values)) < components)
        directions = vectors[:, held]
        directions = directions * np.where(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])] < 0, -1.0, 1.0) if held.any() else directions
        return cls(moments.n, moments.sums, values[held], directions, float(np.trace(moments.scatter)) / moments.n)

    def _times(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as int64 where all fits, else as Python integers."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self._times(x).astype(float) / self.n) @ self.directions / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 a row, exactly; None where a long can't hold it."""
        times = self._times(x)
        if times.dtype == object or x.shape[1] * float(np.abs(times).max(initial=0)) ** 2 >= 2.0**62:
            exact = (times.astype(object) ** 2).sum(1)
            return [int(v) if v < 1 << 63 else None for v in exact]
        return (times**2).sum(1).tolist()


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, floor(64 * entry) + 1000000 of each entry, of the rows whose vector has only finite entries."""
    finite = F.forall(vector_col, lambda c: F.abs(c.cast("double")) < F.lit(float("inf")))
    x = F.transform(vector_col, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST))).cast("long") + SHIFT)
    return rows.filter(F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, values[starts[at][:, None] + np.arange(d)]


def _gathered(made: Callable[[np.ndarray], np.ndarray | None]) -> Callable[[common.Batches], common.Batches]:
    def run(batches: common.Batches) -> common.Batches:
        by: By = {}
        for batch in batches:
            for _, x in matrices(batch.column("x")):
                y = made(x)
                if y is not None:
                    by = merge(by, {x.shape[1]: Moments.of(y)})
        if by:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(by)], pa.binary())], ["moments"])

    return run


def moments(fit_list: DataFrame, made: Callable[[np.ndarray], np.ndarray | None] = lambda x: x) -> By:
    """Moments of what ``made`` makes of the vectors ``x``, by their length: one a partition, merged in a tree."""
    parts = fit_list.select("x").mapInArrow(_gathered(made), "moments binary").rdd.map(lambda r: pickle.loads(r.moments))
    return parts.treeReduce(merge)


def fit(x: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The whitening of the distinct vectors ``x`` (arrays of longs) of each length."""
    spark = x.sparkSession
    folder = f"{checkpoint_dir(spark)}/whitening-{uuid.uuid4().hex}"
    try:
        x.select("x").distinct().write.parquet(folder)
        fit_list = spark.read.parquet(folder)
        if fit_list.isEmpty():
            return {}
        models = {d: Model.of(m, components) for d, m in moments(fit_list).items() if d}
        models = {d: model for d, model in models.items() if len(model.variances)}
        if models:
            for d, m in moments(fit_list, lambda v: models[v.shape[1]].whitened(v) if v.shape[1] in models else None).items():
                models[d].identity_error = float(np.abs(m.scatter / m.n - np.eye(len(m.scatter))).max())
        return models
    finally:
        remove_folder(spark, folder)


def _whitened(models: dict[int, Model], schema: pa.Schema) -> Callable[[common.Batches], common.Batches]:
    def run(batches: common.Batches) -> common.Batches:
        for batch in batches:
            for at, x in matrices(batch.column("x")):
                model = models.get(x.shape[1])
                if model is None:
                    continue
                k, rows = len(model.variances), len(at)
                each = [
                    batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                    np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                    np.full(rows * k, model.n),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    model.whitened(x).ravel(),
                    np.tile(model.variances / model.total, rows),
                    np.full(rows * k, model.identity_error),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(each, schema, strict=True)], schema=schema)

    return run


def whiten(rows: DataFrame, models: dict[int, Model] | None = None, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of each row, one row a component: vec_id, component (from 1, by falling variance), n,
    deviation, whitened, explained, identity_error.

    Rows whose vector is null, or holds a null, NaN or infinite entry, are left out. Vectors of another length are
    another space with a fit of its own. Repeated vectors count once in the fit, and each row is returned.
    Components without variance (equal vectors, fewer vectors than dimensions) are left out, so a single vector, an
    empty vector and an empty table give no row. Deviation is null where it is beyond a long; an entry of more than
    2^61 / 64 counts as that. Ids may be null or repeated, and more columns don't matter.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

    x = integers(rows, id_col, vector_col)
    models = fit(x, components) if models is None else models
    kinds = {"component": IntegerType(), "n": LongType(), "deviation": LongType(), "whitened": DoubleType(), "explained": DoubleType(), "identity_error": DoubleType()}
    schema = StructType([StructField("vec_id", x.schema["vec_id"].dataType), *(StructField(c, t) for c, t in kinds.items())])
    return x.mapInArrow(_whitened(models, to_arrow_schema(schema)), schema)
