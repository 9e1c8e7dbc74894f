"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers ``x = floor(scale * entry) + shift``; each distinct x vector counts once (the fit list)
and is centred exactly. The bidiagonalisation alternates the products ``X v`` and ``X' u`` of the centred rows, one
pass over the stored rows a step. A left vector is long (an entry a row), so it is never gathered: every left vector
lies in the span of the columns, is held as ``u = X p`` with a short ``p``, and is formed anew inside the tasks,
where its products with all earlier left vectors are summed for the full reorthogonalisation. Right vectors are
reorthogonalised on the driver. The small bidiagonal matrix's singular value decomposition gives components
(right vectors) and deviations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
# Bytes of one block of rows, the unit that tasks multiply.
BLOCK_BYTES = 1 << 20
# A length below this share of the largest one is taken as zero; left vectors are orthogonalised again above AGAIN.
ZERO, AGAIN, SEED = 1e-12, 1e-8, 11
# The largest residual of a wanted component, as a share of the first deviation, at which the steps end.
TOLERANCE = 1e-15
MOST = 2 ** 63 - 1
# Sums of tasks are added on the driver up to so many numbers, by a tree of tasks beyond.
NUMBERS = 1_000_000


@dataclass
class Whitening:
    """The fitted transform. ``middle + rest`` is the mean: a whole number and a remainder below one per dimension."""
    n: int = 0
    sums: list[int] = field(default_factory=list)
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float = 0.0
    steps: int = 0

    @property
    def middle(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, self.middle, strict=True)])


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """``_id`` and ``_x``, the whole-number vector, of rows whose vector has no null or non-finite entry. Beyond the
    range of a long an entry is its nearest end."""
    kind = next(f.dataType for f in vectors.schema.fields if f.name == vec_col)
    entries = F.col(vec_col) if isinstance(kind, T.ArrayType) else F.lit(None).cast("array<double>")
    base = vectors.select(F.col(id_col).alias("_id"), entries.cast("array<double>").alias("_v"))

    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    fine = F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", bad)
    edge = float(2 ** 62)
    return base.where(fine).select("_id", F.transform("_v", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(edge)), F.lit(-edge))).cast("long") + shift).alias("_x"))


def _rows(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def row_blocks(rows: DataFrame, d: int) -> DataFrame:
    """Rows packed into blocks of little-endian longs, for tasks that multiply whole matrices."""
    most = max(1, BLOCK_BYTES // (8 * d))

    def run(it):
        held, count = [], 0
        for batch in it:
            x = _rows(batch, "_x", d)
            held.append(x)
            count += len(x)
            while count >= most:
                x = np.concatenate(held)
                yield pa.RecordBatch.from_arrays([pa.array([x[:most].astype("<i8").tobytes()], pa.binary())], ["block"])
                held, count = [x[most:]], count - most
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).astype("<i8").tobytes()], pa.binary())], ["block"])
    return rows.select("_x").mapInArrow(run, "block binary")


class Rows:
    """The stored fit list, whose centred rows take part in sums over all tasks."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        model = Whitening(n, sums)
        self.blocks, self.d, self.middle, self.rest = blocks.rdd, len(sums), np.array(model.middle, np.int64), model.rest

    def sums(self, fn, width: int) -> np.ndarray:
        """Sum over all rows of ``fn(centred rows)``, ``width`` numbers: each task adds its own, then a tree
        adds the tasks'. The same few numbers a task at any size, and no plan to make anew for each of many products."""
        d, middle, rest = self.d, self.middle, self.rest

        def run(blocks):
            total = np.zeros(width)
            for (raw,) in blocks:
                total += fn((np.frombuffer(raw, "<i8").reshape(-1, d) - middle).astype(float) - rest)
            return [total]
        depth = 1 if self.blocks.getNumPartitions() * width <= NUMBERS else 2
        return self.blocks.mapPartitions(run).treeReduce(np.add, depth)


def bidiagonalise(rows: Rows, steps: int, wanted: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, float]:
    """``V`` (d x k, orthonormal), upper bidiagonal ``B`` (k x k) with ``X V = U B`` and ``U' U = 1``, and |X|^2.

    The steps end when V fills the space, or when the wanted components have settled and what is left of X outside
    V is smaller than the last of them, so that none can be missing. Where a product vanishes the chain goes on from
    a new vector orthogonal to all before.
    """
    d = rows.d
    energy = float(rows.sums(lambda x: np.array([np.einsum("ij,ij->", x, x)]), 1)[0])
    V, P, XU, B = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, 0))
    rng = np.random.default_rng(SEED)
    if energy <= 0:
        return V, B, 0.0
    large = np.sqrt(energy)

    def fresh() -> np.ndarray:
        while True:
            v = orthogonal(rng.normal(size=d))
            if np.linalg.norm(v) > 1e-3:
                return v / np.linalg.norm(v)

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - V @ (V.T @ v)
        return v

    def multiply(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of ``y = X q``, formed row by row in the tasks: |y|^2, X' y and the products with the left vectors."""
        k = P.shape[1]

        def fn(x, q=q, p=P):
            y = x @ q
            return np.r_[y @ y, x.T @ y, (x @ p).T @ y]
        got = rows.sums(fn, 1 + d + k)
        return got[0], got[1:1 + d], got[1 + d:]

    v, beta = fresh(), 0.0
    while True:
        k = V.shape[1]
        q = v - beta * P[:, -1] if k else v
        square, back, along = multiply(q)
        if np.linalg.norm(along) > AGAIN * np.sqrt(max(square, 0)):
            q = q - P @ along
            square, back, along = multiply(q)
        q, back, square = q - P @ along, back - XU @ along, square - along @ along
        V = np.c_[V, v]
        alpha = np.sqrt(max(square, 0.0))
        grown = np.zeros((k + 1, k + 1))
        grown[:k, :k] = B
        if k:
            grown[k - 1, k] = beta
        none = alpha <= ZERO * large
        grown[k, k] = 0.0 if none else alpha
        B = grown
        P = np.c_[P, np.zeros(d) if none else q / alpha]
        XU = np.c_[XU, np.zeros(d) if none else back / alpha]
        if V.shape[1] >= min(steps, d):
            return V, B, energy
        w = orthogonal(XU[:, -1] - alpha * v) if not none else np.zeros(d)
        beta = float(np.linalg.norm(w))
        if beta <= ZERO * large:
            v, beta = fresh(), 0.0
        else:
            v = w / beta
        if k + 1 >= wanted:
            left, s, _ = np.linalg.svd(B)
            outside = energy - float((B ** 2).sum())
            if s[wanted - 1] > 0 and beta * np.abs(left[-1, :wanted]).max() <= tolerance * s[0] and outside < s[wanted - 1] ** 2:
                return V, B, energy


def fit_whitening(whole: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> Whitening:
    """Fit on the distinct ``_x`` of ``whole``, all of one length, which ``whole`` must keep (see ``whole_vectors``)."""
    first = whole.select(F.size("_x")).first()
    if first is None:
        return Whitening()
    d = first[0]
    distinct = whole.select("_x").distinct()  # equal vectors meet after each task has dropped its own repeats
    blocks = stored(row_blocks(distinct, d), "whitening-rows")

    def count(it):
        total, n = [0] * d, 0
        for batch in it:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_py(), "<i8").reshape(-1, d)
                n += len(x)
                low, high = x & 0xFFFFFFFF, x >> 32  # halves, whose sums of a block fit a long
                total = [t + int(a) + (int(b) << 32) for t, a, b in zip(total, low.sum(0), high.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["i", "v"])
    got = dict(blocks.mapInArrow(count, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect())
    n, sums = int(got[0]), [int(got[i + 1]) for i in range(d)]
    rows = Rows(blocks, n, sums)
    V, B, energy = bidiagonalise(rows, steps or d, min(components, d))
    if energy <= 0:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0))
    _, s, right = np.linalg.svd(B)
    take = min(components, int((s > 1e-10 * s[0]).sum()))
    q = V @ right[:take].T
    q /= np.linalg.norm(q, axis=0)
    q *= np.sign(q[np.abs(q).argmax(0), np.arange(take)])
    e = s[:take] ** 2 / n
    root = q / np.sqrt(e)

    def moments(x):
        y = x @ root
        return np.r_[y.sum(0), (y.T @ y).ravel()]
    got = rows.sums(moments, take + take * take)
    mean = got[:take] / n
    error = np.abs(got[take:].reshape(take, take) / n - np.outer(mean, mean) - np.eye(take)).max()
    return Whitening(n, sums, q, e, energy / n, float(error), V.shape[1])


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """The exact sum of ``(n x - S)^2`` of each row; null where it passes the range of a long."""
    far = [max(abs(model.n * int(a) - s), abs(model.n * int(b) - s)) for a, b, s in zip(x.min(0), x.max(0), model.sums, strict=True)]
    if max(abs(int(x.min())), abs(int(x.max()))) * model.n <= MOST // 2 and sum(f * f for f in far) <= MOST:
        return ((model.n * x - np.array(model.sums, np.int64)) ** 2).sum(1).tolist()
    totals = [sum((model.n * v - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x.tolist()]
    return [t if t <= MOST else None for t in totals]


def project(whole: DataFrame, model: Whitening, id_col: str) -> DataFrame:
    """A row per vector and component of ``whole``."""
    kind = whole.schema["_id"].dataType.simpleString()
    d, k = model.components.shape
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    middle, rest = (np.array(model.middle, np.int64), model.rest) if model.n else (None, None)

    def run(it):
        for batch in it:
            if not batch.num_rows or not k:
                continue
            x = _rows(batch, "_x", d)
            y = ((x - middle).astype(float) - rest) @ (model.components / np.sqrt(model.eigenvalues))
            m = len(x) * k
            dev = pa.array(deviations(x, model), pa.int64())
            index = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(m, model.n), pa.int64()),
                 dev.take(index), pa.array(y.ravel()), pa.array(np.tile(model.eigenvalues / model.trace, len(x))), pa.array(np.full(m, model.identity_error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return whole.mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id",
           vec_col: str = "embedding", steps: int | None = None) -> DataFrame:
    """Per row and component (numbered from 1 by falling eigenvalue): ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows with a null vector or a null or non-finite entry, and empty vectors, have no result. Vectors of another
    length than most rows have (of lengths as frequent, the larger) can't be compared and have none either.
    Components without deviation don't exist: fewer distinct vectors than components give fewer, one distinct
    vector gives none, an empty table an empty result. Repeated rows and null ids are each reported, and equal
    vectors count once in the fit. Other columns are not looked at, whatever their names. Sums of squares beyond
    a long are null.
    """
    whole = stored(whole_vectors(vectors, id_col, vec_col, scale, shift), "whitening-vectors")
    sizes = whole.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is not None:
        whole = whole.where(F.size("_x") == sizes["d"])
    return project(whole, fit_whitening(whole, components, steps), id_col)
