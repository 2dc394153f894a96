"""Sorted digest array: 64-bit xxhash keys in sorted, memory-mapped shards, with the full keys kept to rule out collisions.

Spark builds the shards: rows are dealt by a range of the digest, sorted, and each shard is written by one task
as four flat files (digests, key ends, key bytes, value bytes). A lookup hashes a whole batch, finds its places by one
vectorised binary search per shard, and compares the stored key with the asked one; equal digests with other keys
stand next to each other and are stepped through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphbatch.llm.files import memory_map, write_atomic

PARTS = {"digests": "<i8", "ends": "<i8", "keys": "u1", "values": "u1"}


def digest(key: bytes) -> int:
    """Signed, so that Spark's long order and the array's order are the same."""
    h = xxhash.xxh64_intdigest(key)
    return h - (1 << 64) if h >= 1 << 63 else h


def build_index(entries: DataFrame, uri: str, shard_rows: int = 500_000) -> int:
    """Write (key binary, value binary) rows as an index; of equal keys the smallest value stays. Returns the number of shards."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"digest": np.fromiter(map(digest, b["key"]), "i8", len(b)), "key": b["key"], "value": b["value"]})

    unique = entries.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.coalesce("value", F.lit(b""))).alias("value"))
    rows = unique.mapInPandas(hashed, "digest long, key binary, value binary")
    # Shards are equal ranges of the 64-bit digest, which is uniform, so they are even without a look at the data.
    n = max(1, -(-unique.count() // shard_rows))
    shard = F.least(F.lit(n - 1), F.floor((F.col("digest") / F.lit(2.0**64) + 0.5) * n)).cast("int")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}

        def flush(k: int) -> pd.DataFrame:
            b = pd.concat(held.pop(k), ignore_index=True)
            key_ends, value_ends = b["key"].map(len).cumsum(), b["value"].map(len).cumsum()
            ends = np.column_stack([key_ends, value_ends]).astype("<i8")
            for name, data in (("digests", b["digest"].to_numpy("<i8").tobytes()), ("ends", ends.tobytes()), ("keys", b"".join(b["key"])), ("values", b"".join(b["value"]))):
                write_atomic(f"{uri}/{name}-{k:05d}", lambda out, data=data: out.write(data))
            return pd.DataFrame({"shard": [k], "n": [len(b)]})

        for b in batches:  # sorted by shard, so a shard is whole when the next one begins
            for k, part in b.groupby("shard", sort=True):
                for done in [x for x in held if x != k]:
                    yield flush(done)
                held.setdefault(int(k), []).append(part)
        for done in list(held):
            yield flush(done)

    written = rows.withColumn("shard", shard).repartition(n, "shard").sortWithinPartitions("shard", "digest", "key").mapInPandas(write, "shard int, n long").collect()
    present = {r["shard"] for r in written}
    for k in set(range(n)) - present:
        for name in PARTS:
            write_atomic(f"{uri}/{name}-{k:05d}", lambda out: out.write(b""))
    return n


class DigestIndex:
    """Reader of an index; open one per process and keep it, the arrays are memory-mapped."""

    _open: dict[str, "DigestIndex"] = {}

    def __init__(self, uri: str, shards: int):
        self.shards = [{name: memory_map(f"{uri}/{name}-{k:05d}", kind) for name, kind in PARTS.items()} for k in range(shards)]
        for s in self.shards:
            s["ends"] = s["ends"].reshape(-1, 2)

    @classmethod
    def cached(cls, uri: str, shards: int) -> "DigestIndex":
        if uri not in cls._open:
            cls._open[uri] = cls(uri, shards)
        return cls._open[uri]

    def lookup(self, keys: list[bytes]) -> list[bytes | None]:
        """The value of each key, None where it is not stored."""
        out: list[bytes | None] = [None] * len(keys)
        if not keys:
            return out
        hashes = np.fromiter(map(digest, keys), "i8", len(keys))
        place = np.minimum(len(self.shards) - 1, np.floor((hashes / 2.0**64 + 0.5) * len(self.shards)).astype("i8"))
        for k, s in enumerate(self.shards):
            mine = np.flatnonzero(place == k)
            if not len(mine) or not len(s["digests"]):
                continue
            stored, ends = s["digests"], s["ends"]
            keys_of, values_of = memoryview(s["keys"]), memoryview(s["values"])
            at = np.searchsorted(stored, hashes[mine])
            hit = (at < len(stored)) & (stored[np.minimum(at, len(stored) - 1)] == hashes[mine])
            asked, at = mine[hit], at[hit]
            until = np.asarray(ends[at])
            since = np.where(at[:, None] > 0, ends[np.maximum(at, 1) - 1], 0)
            for q, j, (ka, va), (kb, vb) in zip(asked.tolist(), at.tolist(), since.tolist(), until.tolist(), strict=True):
                while keys_of[ka:kb] != keys[q]:  # another key with the same digest: look at the next place
                    j += 1
                    if j == len(stored) or stored[j] != hashes[q]:
                        break
                    (ka, va), (kb, vb) = (kb, vb), ends[j].tolist()
                else:
                    out[q] = bytes(values_of[va:vb])
        return out
