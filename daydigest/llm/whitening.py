"""Embedding whitening by mixed-precision refinement.

Vectors become whole numbers, so that sums, covariance and distances from the mean are exact however the
rows are dealt out. The eigenvectors of the covariance are first found in float32 and then corrected in
extended precision by the matrix products of Ogita and Aishima: each step squares the error of
vectors whose eigenvalues are well apart. Vectors of clustered eigenvalues are turned within their cluster
by a sub-solve of the small matrix they span, whose common shift is taken off first.

Only sums of the size of a vector and of its square pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daydigest.llm.common import bounded_batches
from daydigest.session import cut_lineage

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
# Entries beyond it in size have no whole number of 64 bits.
MOST_ENTRY = float(1 << 55)
# Eigenvalues up to this share of their sum are rounding, not variance.
RANK_FLOOR = 1e-12
STEPS = 40
EXACT = 1 << 53
PART = (1 << 60) - 1
WIDE = np.longdouble
WHOLE = pa.decimal128(38, 0)


def usable(vector: Column) -> Column:
    """True where a vector is there, is not empty and has finite entries of 64 bits only."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < MOST_ENTRY))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def whole_numbers(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """A row of whole numbers for each vector of a batch."""
    values = batch["vector"].flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * values).astype(np.int64).reshape(-1, size) + SHIFT


def exact_squares(d: np.ndarray) -> np.ndarray:
    """d' d of whole numbers as Python integers: by a float product where no sum can round."""
    most = int(np.abs(d).max(initial=0))
    if most * most * max(1, len(d)) < EXACT:
        f = d.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    d = d.astype(object)
    return d.T @ d


def sums_of(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors and the sums of their entries; (0, no entries) without vectors. Vectors
    of another length than the most frequent one (of equally frequent ones the longest) do not count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            lengths = batch["vector"].value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                x = whole_numbers(batch.filter(pa.array(lengths == size)), int(size))
                # the shift is added again below; halves of 32 bits cannot overflow in a batch
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                s = high.astype(object) * (1 << 32) + low.astype(object)
                n, total = found.get(size, (0, 0))
                found[size] = [n + len(x), total + s]
        for size, (n, total) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(list(total), WHOLE)],
                names=["size", "i", "n", "s"],
            )

    parts = vectors.mapInArrow(work, "size int, i int, n long, s decimal(38,0)")
    parts = cut_lineage(parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "vector-sums")
    first = parts.filter("i = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if first is None:
        return 0, np.zeros(0, object)
    rows = parts.filter(F.col("size") == first["size"]).orderBy("i").collect()
    return first["n"], np.array([int(r["s"]) for r in rows], object)


def scatter(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """n * n times the covariance, as Python integers. Vectors are centred at the whole number next to
    the mean before they are multiplied; what the centre is off by is taken out exactly."""
    size = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for batch in batches:
            total = total + exact_squares(whole_numbers(batch, size) - centre)
        i, j = (pa.array(at.astype(np.int32)) for at in upper)
        # in two parts, as sums of squares of 61 bits are beyond 38 digits
        high, low = (pa.array([f(v) for v in total[upper]], WHOLE) for f in (lambda v: v >> 60, lambda v: v & PART))
        yield pa.RecordBatch.from_arrays([i, j, high, low], names=["i", "j", "high", "low"])

    parts = vectors.mapInArrow(work, "i int, j int, high decimal(38,0), low decimal(38,0)")
    parts = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = np.zeros((size, size), object)
    for r in parts.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = (int(r["high"]) << 60) + int(r["low"])
    off = sums - n * centre.astype(object)
    return n * out - np.outer(off, off)


def clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Runs of the sorted eigenvalues in which neighbours lie within ``width``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return np.split(order, cuts)


def refined_step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """One correction of approximate eigenvectors ``x``: new vectors, eigenvalues, clusters and the
    largest entry of the correction."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    # rounded alike on both sides, else close eigenvalues would bend the angles between their vectors
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diagonal(s) / (1 - np.diagonal(r))
    loose = s - np.diag(values)
    width = 2 * (np.sqrt((loose * loose).sum()) + np.abs(values).max() * np.sqrt((r * r).sum()))
    together = clusters(values, width)
    apart = np.ones(a.shape, bool)
    for members in together:
        apart[np.ix_(members, members)] = False
    gap = np.where(apart, values[None, :] - values[:, None], 1)
    # of vectors in one cluster only lengths and angles are mended here
    change = np.where(apart, (s + values[None, :] * r) / gap, r / 2)
    return x + x @ change, values, together, float(np.abs(change).max())


def sub_solve(a: np.ndarray, x: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Turn the vectors of one cluster into eigenvectors of the matrix that they span. Without the
    eigenvalues' mean, that matrix has entries of the cluster's own width, so that double
    precision tells its eigenvalues apart."""
    part = x[:, members]
    small = part.T @ (a @ part)
    small = small - np.eye(len(members), dtype=WIDE) * (np.trace(small) / len(members))
    size = np.abs(small).max()
    if size > 0:
        turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1]
        part = part @ turn.astype(WIDE)
    return part


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended
    precision. The largest entry of each vector is positive."""
    size = np.abs(a).max()
    if not size > 0:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    before = np.inf
    for _ in range(STEPS):
        x, _, together, change = refined_step(a, x)
        close = [members for members in together if len(members) > 1]
        if change < 1e-3:  # else the vectors' lengths and angles come first
            for members in close:
                x[:, members] = sub_solve(a, x, members)
        if change < 1e-17 or (change < 1e-8 and change > before / 2):
            # no step gains any more: close eigenvalues leave that much to rounding
            break
        before = change
    # a sub-solve turns in double; lengths and angles are mended once more
    x = x + x @ ((np.eye(len(a), dtype=WIDE) - x.T @ x) / 2)
    values = np.diagonal(x.T @ (a @ x)) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    x = x / np.sqrt((x * x).sum(axis=0))
    lead = x[np.abs(x).argmax(axis=0), np.arange(len(a))]
    return values * size, x * np.where(lead < 0, -1, 1)


def identity_error(rows: DataFrame, kept: int, n: int) -> float:
    """The largest entry of the covariance of the written ``whitened`` vectors minus the identity."""
    i, j = np.triu_indices(kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            w = batch["whitened"].flatten().to_numpy().reshape(-1, kept)
            total += w.sum(axis=0)
            squares += w.T @ w
        at = [np.concatenate([i, np.arange(kept)]), np.concatenate([j, np.full(kept, -1)])]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x.astype(np.int32)) for x in at), pa.array(np.concatenate([squares[i, j], total]))], names=["i", "j", "v"]
        )

    # the vectors are centred already; what their mean is off by is taken out
    parts = rows.select("whitened").mapInArrow(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = {(r["i"], r["j"]): r["v"] / n for r in parts.collect()}
    return max(abs(found[p, q] - found[p, -1] * found[q, -1] - (p == q)) for p, q in zip(i.tolist(), j.tolist()))


WHITE = "deviation long, whitened array<double>"


def whiten(table: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> tuple[DataFrame, dict]:
    """vec_id, deviation, whitened (array) for each row that takes part, as a written table, and the
    model: n, sums, values, vectors (columns), total (trace of the covariance), explained, identity_error.

    Rows whose vector is null or empty or has null or non-finite entries (or such as 64 bits do not
    hold as whole numbers) take no part, nor do vectors of another length than the most frequent
    one. ``deviation`` is the exact sum of (n * x - S)^2, null where a long cannot hold it. Components
    whose eigenvalue is no more than rounding (``RANK_FLOOR`` of the trace) are left out, so copies of one
    vector have none and ``whitened`` is empty. Repeated rows and null ids count as they stand; an empty
    table gives no rows and n = 0.
    """
    bounded_batches(table.sparkSession)
    rows = table.select("vec_id", F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    n, sums = sums_of(rows.select("vector"))
    size = len(sums)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not n:
        none = table.sparkSession.createDataFrame([], f"vec_id {kind}, {WHITE}")
        return none, {"n": 0, "sums": sums, "values": sums, "vectors": sums, "total": 0.0, "explained": [], "identity_error": None}
    rows = rows.filter(F.size("vector") == size)
    spread = scatter(rows.select("vector"), n, sums)
    covariance = np.array([[WIDE(v) for v in row] for row in spread]) / (WIDE(n) * WIDE(n))
    values, vectors = eigenvectors(covariance)
    total = np.trace(covariance)
    kept = int((values[:components] > RANK_FLOOR * total).sum()) if total > 0 else 0
    turned = (vectors[:, :kept] / np.sqrt(values[:kept])).astype(np.float64)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    off = np.array([int(s - n * int(c)) for s, c in zip(sums, centre)], object)
    rest = (off / n).astype(np.float64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = whole_numbers(batch, size) - centre
            most = (int(np.abs(d).max(initial=0)) + 1) * n
            if most * most * size < 1 << 63:
                far = n * d - off.astype(np.int64)
                deviation = pa.array((far * far).sum(axis=1))
            else:
                far = n * d.astype(object) - off
                sums_far = (far * far).sum(axis=1)
                deviation = pa.array([v if v < 1 << 63 else None for v in sums_far], pa.int64())
            white = (d - rest) @ turned
            ends = np.arange(len(d) + 1, dtype=np.int32) * kept
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], deviation, pa.ListArray.from_arrays(ends, white.reshape(-1))],
                names=["vec_id", "deviation", "whitened"],
            )

    white = cut_lineage(rows.mapInArrow(work, f"vec_id {kind}, {WHITE}"), "whitened")
    model = {
        "n": n,
        "sums": sums,
        "values": values[:kept],
        "vectors": vectors[:, :kept],
        "total": float(total),
        "explained": [float(v / total) for v in values[:kept]],
        "identity_error": identity_error(white, kept, n) if kept else None,
    }
    return white, model


def whitened_rows(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each
    vector and component; see ``whiten``."""
    white, model = whiten(table, components)
    long = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(e) for e in model["explained"]]).cast("array<double>")
    error = model["identity_error"]
    return long.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model["n"]).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(math.nan if error is None else error).alias("identity_error"),
    )
