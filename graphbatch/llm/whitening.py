"""Whitening of embeddings by a covariance over distinct vectors, each weighted by how often it occurs.

Entries become integers, so equal vectors are equal exactly and sums are exact. Spark groups equal vectors; sums, the covariance (a weighted,
centred product of matrices in each task, added up over tasks) and the whitening itself then touch each distinct vector once, and
rows take their result through a join on the vector's SHA-256. Only sums, the matrix of the dimension and its eigenvectors pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphbatch.functions.vectors import sum_vectors
from graphbatch.llm.common import slices, write_and_reread

SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this size count as not finite: as integers they would leave the range in which everything is exact.
LARGEST = float(1 << 24)
#: Directions whose variance is below this share of the largest have none but rounding.
LEAST_SHARE = 1e-9


def integer_vectors(rows: DataFrame, keep: list[str], vec: str = "embedding") -> DataFrame:
    """(row, x): rows whose vector has finite entries only, as a struct of ``keep``, with x = floor(64 c) + 1000000.

    Null vectors, null entries, entries that are not finite or beyond 2**24, and empty vectors are dropped.
    """
    v = F.col(vec).cast("array<double>")
    sound = F.size(v) > 0
    sound = sound & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.struct(*keep).alias("row"), F.transform(v, lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def digest(x: str = "x") -> Column:
    return F.unhex(F.sha2(F.array_join(F.col(x).cast("array<string>"), ","), 256))


def distinct_vectors(vectors: DataFrame, weights: str = "count") -> DataFrame:
    """(id, x, c, w): each distinct vector with its digest, count and fit weight, ``count`` or ``one``. Vectors of another than the commonest length (of equal ones the longer) are left out."""
    if weights not in ("count", "one"):
        raise ValueError(f"unknown weights: {weights}")
    each = write_and_reread(vectors.groupBy("x").agg(F.count("*").alias("c")).select(digest().alias("id"), "x", "c", (F.col("c") if weights == "count" else F.lit(1).cast("long")).alias("w")), "distinct")
    lengths = each.groupBy(F.size("x").alias("d")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    return each.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def weighted_sums(each: DataFrame) -> tuple[int, list[int]]:
    """(n, S): the sum of weights and the weighted sum of each entry, exact."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = 0, None
        for b in batches:
            w = b["w"].to_numpy()
            part = w @ np.stack(b["x"].to_numpy())
            n, s = n + int(w.sum()), part if s is None else s + part
        if s is not None:
            yield pd.DataFrame({"at": np.arange(-1, len(s)), "v": np.concatenate([[n], s])})

    rows = each.select("x", "w").mapInPandas(partial, "at int, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()
    told = {r["at"]: int(r["v"]) for r in rows}
    return told.get(-1, 0), [told[k] for k in range(len(told) - 1)]


def weighted_products(each: DataFrame, vec: str, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of w d d^T over rows, d being the centred vector: one product of matrices a batch, partial sums a task, added up by matrix row."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in slices(batches, 4096):
            d = centred(np.stack(b[vec].to_numpy()))
            part = (d * b["w"].to_numpy()[:, None]).T @ d
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "vec": list(total)})

    rows = sum_vectors(each.select(vec, "w").mapInPandas(partial, "at long, vec array<double>"), ["at"], "vec", None).collect()  # a row a dimension
    return np.array([r["vec"] for r in sorted(rows, key=lambda r: r["at"])]) if rows else None


@dataclass(frozen=True)
class Whitening:
    """n, floor(S / n) and S - n floor(S / n) of each entry, and the components that have variance, strongest first."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the integer part is exact, so large means cost no digits."""
        return (x - self.base) - self.rest / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over entries of (n x - S)^2, exact; none where it is beyond a signed 64-bit integer."""
        r = x - self.base
        if (self.n * (int(np.abs(r).max(initial=0)) + 1)) ** 2 * x.shape[1] < 1 << 63:
            return ((self.n * r - self.rest) ** 2).sum(1).tolist()
        exact = ((self.n * r.astype(object) - self.rest.astype(object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact.tolist()]


def fit(each: DataFrame, most: int = 32) -> Whitening | None:
    """Mean, covariance (divisor n) and eigenvectors of weighted distinct vectors; none where there are no vectors."""
    n, sums = weighted_sums(each)
    if not n:
        return None
    base, rest = (np.array([f(s, n) for s in sums], np.int64) for f in (lambda s, n: s // n, lambda s, n: s % n))
    start = Whitening(n, base, rest, np.zeros((0, len(sums))), np.zeros(0), 0.0)
    v = weighted_products(each, "x", start.centred) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > LEAST_SHARE * values.max()][:most]
    return Whitening(n, base, rest, vectors[:, order].T, values[order], float(np.trace(v)))


def whiten_distinct(each: DataFrame, model: Whitening) -> DataFrame:
    """(id, w, deviation, y): each distinct vector whitened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, 4096):
            x = np.stack(b["x"].to_numpy())
            yield pd.DataFrame({"id": b["id"].to_numpy(), "w": b["w"].to_numpy(), "deviation": pd.array(model.deviations(x), "Int64"), "y": list(model.whiten(x))})

    return write_and_reread(each.select("id", "x", "w").mapInPandas(run, "id binary, w long, deviation long, y array<double>"), "whitened")


def identity_error(white: DataFrame, n: int) -> float:
    """The largest entry, by size, of the covariance of whitened vectors minus the identity."""
    at = white.select(F.posexplode("y").alias("at", "v"), "w").groupBy("at").agg((F.sum(F.col("v") * F.col("w")) / n).alias("m")).orderBy("at").collect()  # a row a component
    mean = np.array([r["m"] for r in at])
    if not len(mean):
        return 0.0
    return float(np.abs(weighted_products(white, "y", lambda y: y - mean) / n - np.eye(len(mean))).max())


def whiten(rows: DataFrame, keep: list[str], vec: str = "embedding", most: int = 32, weights: str = "count") -> DataFrame:
    """(keep..., component, n, deviation, whitened, explained, identity_error): one row for each row of the table and component.

    Dropped rows: see ``integer_vectors`` and ``distinct_vectors``. ``n`` is the sum of fit weights. There are as many components as the dimension and
    ``most`` allow and as have variance: none, and so no rows, where all vectors are equal or none is left. ``deviation`` is null where it doesn't
    fit into 64 bits. Repeated rows and rows without an id are kept. Equal eigenvalues stand in the order of the solver, the same for all rows.
    A vector that very many rows share is one row on the other side of the join, whose large partitions Spark splits.
    """
    vectors = integer_vectors(rows, keep, vec)
    each = distinct_vectors(vectors, weights)
    model = fit(each, most)
    if model is None or not len(model.variances):
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
        return rows.sparkSession.createDataFrame([], f"{types}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = whiten_distinct(each, model)
    error = identity_error(white, model.n)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.variances))
    out = vectors.select("row", digest().alias("id")).join(white.drop("w"), "id").select(*(F.col("row").getField(c).alias(c) for c in keep), "deviation", F.posexplode("y").alias("k", "whitened"))
    return out.select(*keep, (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))
