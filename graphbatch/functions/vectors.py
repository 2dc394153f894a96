"""Weighted sums of vectors by key, with partial sums before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_vectors(rows: DataFrame, keys: list[str], vec: str = "vec", weight: str | None = "weight", partials: int = 50_000) -> DataFrame:
    """(keys, vec, n): per key the sum of weight x vec and the number of rows. Keys are longs.

    Rows are summed within a task, which sends on what it holds at ``partials`` keys; the partial sums are shuffled by key and
    summed in key order, one key at a time, so memory doesn't grow with the keys or with a hub's degree.
    """
    shape = ", ".join(f"{k} long" for k in keys) + ", vec array<double>, n long"

    def frame(held: dict[tuple, list]) -> pd.DataFrame:
        out = pd.DataFrame(list(held), columns=keys)
        return out.assign(vec=[v[0] for v in held.values()], n=[v[1] for v in held.values()])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for b in batches:
            x = np.stack(b["vec"].to_numpy()) * b["w"].to_numpy()[:, None]
            codes, index = pd.MultiIndex.from_frame(b[keys]).factorize()
            sums = np.zeros((len(index), x.shape[1]))
            np.add.at(sums, codes, x)
            for key, s, n in zip(index.tolist(), sums, np.bincount(codes), strict=True):
                if key in held:
                    held[key][0] = held[key][0] + s
                    held[key][1] += int(n)
                else:
                    held[key] = [s, int(n)]
            if len(held) >= partials:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[tuple, list] = {}
        for b in batches:
            done: dict[tuple, list] = {}
            for key, v, n in zip(b[keys].itertuples(index=False, name=None), b["vec"], b["n"], strict=True):
                if key in last:
                    last[key] = [last[key][0] + v, last[key][1] + n]
                else:
                    done |= last
                    last = {key: [np.array(v), n]}
            if done:
                yield frame(done)
        if last:
            yield frame(last)

    w = F.col(weight) if weight else F.lit(1.0)
    sent = rows.select(*keys, F.col(vec).alias("vec"), w.alias("w")).mapInPandas(partial, shape)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(total, shape)
