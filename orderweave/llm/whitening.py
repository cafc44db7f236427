"""Whitening of embeddings: covariance of the distinct grid vectors, each weighted by its multiplicity.

Vectors are put on an integer grid and equal ones are grouped. Sums are exact; the covariance is a weighted product of
centred matrices, a part per task. Each distinct vector is whitened once, and joined back to the rows that have it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.sums import vector_sums
from orderweave.operators.scan import attach
from orderweave.session import configure, pin, sql

#: x = floor(SCALE * c) + SHIFT for an entry c.
SCALE, SHIFT = 1024, 100_000
#: Grid values are held within this, so that they are exact as doubles: it binds for entries beyond 2**40 only.
BOUND = 1 << 50
COMPONENTS = 8


def _encoded(v: np.ndarray) -> list[bytes]:
    """Grid vectors (without SHIFT) as bytes: two, four or eight a value, the fewest that hold the vector, so equal
    vectors have equal bytes and others do not."""
    most = np.maximum(v.max(axis=1), -(v.min(axis=1) + 1))
    out: list = [None] * len(v)
    for kind, low, high in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 62)):
        some = np.flatnonzero((most >= low) & (most < high))
        packed = v[some].astype(kind)
        for i, row in zip(some.tolist(), packed):
            out[i] = row.tobytes()
    return out


def _decoded(keys: pa.Array, dim: int) -> np.ndarray:
    """The grid vectors x of a column of ``_encoded`` ones."""
    raw = keys.to_pylist()
    x = np.empty((len(raw), dim), np.int64)
    sizes = np.array([len(k) // dim for k in raw])
    for size in (2, 4, 8):
        some = np.flatnonzero(sizes == size)
        if len(some):
            x[some] = np.frombuffer(b"".join([raw[i] for i in some]), f"<i{size}").reshape(len(some), dim)
    return x + SHIFT


def _grid(batches):
    for batch in batches:
        lists = batch.column("embedding")
        sizes = np.diff(lists.offsets.to_numpy())
        for dim in np.unique(sizes):
            mine = pa.array(sizes == dim)
            c = lists.filter(mine).flatten().to_numpy().reshape(-1, dim)
            v = np.clip(np.floor(np.clip(c, -BOUND, BOUND) * SCALE), -BOUND, BOUND).astype(np.int64)
            arrays = [batch.column("vec_id").filter(mine), pa.array(np.full(len(v), dim), pa.int32()), pa.array(_encoded(v), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "dim", "key"])


def _sums(dim: int):
    """Exact weighted sum of each dimension over a partition."""

    def run(batches):
        total = [0] * dim
        for batch in batches:
            if len(batch):
                x, w = _decoded(batch.column("key"), dim), batch.column("fit").to_numpy()
                if int(np.abs(x).max()) * int(w.sum()) < 1 << 62:
                    part = w @ x
                else:
                    part = w.astype(object) @ x.astype(object)
                total = [a + int(b) for a, b in zip(total, part.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(map(str, total), pa.string())], ["i", "total"])

    return run


def _products(mean: np.ndarray):
    """Weighted sum over a partition of the products of centred vectors, a row of it per dimension."""
    dim = len(mean)

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if len(batch):
                x = _decoded(batch.column("key"), dim) - mean
                total += (x * batch.column("fit").to_numpy()[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "vector"])

    return run


def _components(dim: int, n: int, k: int):
    """One task over ``dim`` rows: eigenvalues, unit eigenvectors and trace of the covariance."""

    def run(batches):
        v = np.zeros((dim, dim))
        rows = 0
        for batch in batches:
            for i, raw in zip(batch.column("i").to_pylist(), batch.column("vector").to_pylist()):
                v[i] = np.frombuffer(raw, np.float64) / n
                rows += 1
        if rows:
            values, vectors = np.linalg.eigh((v + v.T) / 2)
            order = np.argsort(-values, kind="stable")[:k]
            basis = vectors[:, order].T
            # one of the two signs: the largest entry is positive
            basis = basis * np.sign(basis[np.arange(len(basis)), np.argmax(np.abs(basis), axis=1)])[:, None]
            arrays = [values[order].tobytes(), np.ascontiguousarray(basis).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in arrays] + [pa.array([float(np.trace(v))])], ["e", "basis", "trace"])

    return run


def squared_deviation(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - total) squared, exact, for each row."""
    most = int(np.abs(x).max())
    if 2 * n * most >= 1 << 62:
        return [int(((n * r - np.array(total, object)) ** 2).sum()) for r in x.astype(object)]
    d = np.abs(n * x - np.array(total, np.int64))
    if int(d.max()) ** 2 * x.shape[1] < 1 << 62:
        return (d * d).sum(axis=1).tolist()
    # limbs of 21 bits, whose products add up within 64
    a, b, c = d >> 42, d >> 21 & 0x1FFFFF, d & 0x1FFFFF
    limbs = [(a * a).sum(1), 2 * (a * b).sum(1), (b * b + 2 * a * c).sum(1), 2 * (b * c).sum(1), (c * c).sum(1)]
    return [((((p << 21) + q << 21) + r << 21) + s << 21) + t for p, q, r, s, t in zip(*[m.tolist() for m in limbs])]


def _whiten(model):
    def run(batches):
        m = model.value
        for batch in batches:
            if not len(batch):
                continue
            x = _decoded(batch.column("key"), len(m["mean"]))
            z = (x - m["mean"]) @ m["whitener"].T
            squares = [s if s < 10**38 else None for s in squared_deviation(x, m["n"], m["total"])]
            z = z.reshape(-1)
            flat = pa.array(z, mask=~np.isfinite(z))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(m["whitener"])), flat)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("key", "weight", "fit")], pa.array([None if s is None else str(s) for s in squares], pa.string()), lists],
                ["key", "weight", "fit", "squares", "whitened"],
            )

    return run


def _merged(parts):
    """(n, mean, centred products) of several sets of weighted rows together."""
    n, mean, products = 0.0, None, None
    for n_, mean_, products_ in parts:
        if mean is None:
            n, mean, products = n_, mean_, products_
        elif n_:
            step = mean_ - mean
            products = products + products_ + np.outer(step, step) * (n * n_ / (n + n_))
            mean = mean + step * (n_ / (n + n_))
            n += n_
    return n, mean, products


def _moments_of(live: np.ndarray):
    """Weight, mean and centred products of the whitened values of a partition."""
    k = len(live)

    def one(batch):
        z = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)[:, live]
        w = batch.column("fit").to_numpy().astype(np.float64)
        mean = w @ z / w.sum()
        return w.sum(), mean, ((z - mean) * w[:, None]).T @ (z - mean)

    def run(batches):
        n, mean, products = _merged(one(b) for b in batches if len(b))
        if mean is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([a.tobytes()], pa.binary()) for a in (mean, products)]], ["n", "mean", "products"])

    return run


def _error(batches):
    """One task over a row per task: how far the covariance is from the identity."""

    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                mean = np.frombuffer(r["mean"])
                yield r["n"], mean, np.frombuffer(r["products"]).reshape(len(mean), -1)

    n, mean, products = _merged(rows())
    if mean is not None:
        yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(products / n - np.eye(len(mean))).max())])], ["error"])


_RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, components: int = COMPONENTS, counts: bool = True) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector of ``rows`` (vec_id, embedding)
    and every component up to ``components``.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out. Entries c become x = floor(1024 c) + 100000
    (held within 2**50, which binds for entries beyond 2**40). The fit list holds the vectors of the commonest
    dimension (the smallest of a tie), as often as they occur with ``counts`` and once otherwise; a vector of another
    dimension cannot be compared with them and gives no row. n and the sums S are those of the fit list; ``deviation`` is the sum
    over dimensions of (n x - S) squared, exact, null beyond 38 digits. Components are unit eigenvectors of the covariance
    of x (divisor n), by falling eigenvalue, their largest entry positive; there are at most as many as dimensions.
    ``whitened`` is null for a component without variance (an eigenvalue within rounding of zero), ``explained`` is its share of the
    trace (null if that is zero), and ``identity_error`` covers the components that have variance (null without any).
    Null and repeated vec_ids are rows like others. An empty table gives no rows.

    The driver holds what the dimension bounds: S, and eight vectors. Hot vectors are folded before the shuffle, and spread over
    it on the way back."""
    spark = configure(rows.sparkSession)
    usable = sql(
        """select cast(vec_id as long) as vec_id, cast(embedding as array<double>) as embedding from {r}
           where size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))""",
        r=rows,
    )
    grid = pin(usable.mapInArrow(_grid, "vec_id long, dim int, key binary"), "grid")
    common = sql("select dim from {g} group by dim order by count(*) desc, dim limit 1", g=grid).first()
    if common is None:
        return spark.createDataFrame([], _RESULT)
    dim = common["dim"]
    grid = grid.where(F.col("dim") == dim).select("vec_id", "key")
    fit = "count(*)" if counts else "1L"
    distinct = pin(sql(f"select key, count(*) as weight, {fit} as fit from {{g}} group by key", g=grid), "distinct")
    n = distinct.agg(F.sum("fit").alias("n")).first()["n"]
    parts = distinct.select("key", "fit").mapInArrow(_sums(dim), "i int, total string")
    found = sql("select i, sum(cast(total as decimal(38, 0))) as total from {p} group by i", p=parts).collect()  # one row a dimension
    total = [int(r["total"]) for r in sorted(found, key=lambda r: r["i"])]
    mean = np.array([t / n for t in total])  # of whole numbers, so rounded once

    rows_of_v = vector_sums(distinct.select("key", "fit").mapInArrow(_products(mean), "i int, vector binary"), "i", "int")
    model = rows_of_v.repartition(1).mapInArrow(_components(dim, n, min(components, dim)), "e binary, basis binary, trace double").first()
    e, basis = np.frombuffer(model["e"]), np.frombuffer(model["basis"]).reshape(-1, dim)
    live = e > max(e[0], 0) * dim * np.finfo(float).eps
    with np.errstate(all="ignore"):
        whitener = np.where(live[:, None], basis / np.sqrt(np.where(live, e, 1))[:, None], np.nan)
    sent = spark.sparkContext.broadcast({"n": n, "total": total, "mean": mean, "whitener": whitener})
    values = pin(
        distinct.mapInArrow(_whiten(sent), "key binary, weight long, fit long, squares string, whitened array<double>").selectExpr(
            "key", "weight", "fit", "cast(squares as decimal(38, 0)) as deviation", "whitened"
        ),
        "whitened",
    )
    error = None
    if live.any():
        moments = values.select("fit", "whitened").mapInArrow(_moments_of(live), "n double, mean binary, products binary")
        error = moments.repartition(1).mapInArrow(_error, "error double").first()
    share = [float(v) / model["trace"] if model["trace"] else None for v in e]
    out = attach(grid, values, ["key"], ["deviation", "whitened"], "vec_id", rows="weight", pinned=True)
    return out.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "value")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.get(F.array(*[F.lit(s).cast("double") for s in share]), "place").alias("explained"),
        F.lit(error["error"] if error else None).cast("double").alias("identity_error"),
    )
