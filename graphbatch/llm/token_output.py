"""Token ids as length-delimited binary records in ascending id order, with a separate offset index.

File format (all little-endian). A record is

    uint64 length | uint32 masked CRC of the length | payload | uint32 masked CRC of the payload

with payload = uint8 has_id | int64 doc_id | uint8 bytes per token | ids. Ids take two bytes where the vocabulary has at most 65,536
entries, else four. A CRC is zlib's CRC-32, masked as ((crc >> 15) | (crc << 17)) + 0xA282EAD8 mod 2^32. ``NAME.idx`` holds a pair of
int64 per record: its place in the file, and the ids before it in the file; a shuffled reader seeks by it.

Texts are dealt by range of the id, each range sorted and encoded while its file is written; a file appears under its name only
when whole, so a task that runs again writes the same file again. The manifest (one row a file) carries the counts from
which the global starts are summed. Null ids come first; equal ids keep the order of their texts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphbatch.llm.bpe import WordCoder, default_tokenizer
from graphbatch.llm.common import write_and_reread
from graphbatch.llm.files import memory_map, open_fs, write_atomic

MASK = 0xA282EAD8
HEAD = struct.Struct("<BqB")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def pack_record(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = HEAD.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def read_record(source) -> tuple[int | None, np.ndarray] | None:
    """The next record of a stream, None at its end; a damaged one raises ValueError."""
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("damaged record length")
    n = struct.unpack("<Q", head[:8])[0]
    body = source.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked_crc(body[:n]):
        raise ValueError("damaged record payload")
    has_id, doc_id, width = HEAD.unpack_from(body)
    return (doc_id if has_id else None), np.frombuffer(body, f"<u{width}", offset=HEAD.size, count=(n - HEAD.size) // width)


def write_token_files(docs: DataFrame, uri: str, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode, append ``end_id`` and write; returns the manifest (part, file, n_docs, n_ids, base) in the order of the ids."""
    path = tokenizer_path or default_tokenizer()
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, coder = TaskContext.get().partitionId(), WordCoder.cached(path)
        width = 2 if max(coder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        name, places, n_ids = f"{uri}/tokens-{part:06d}", [], 0
        end = np.array([end_id], "<u4")

        def fill(out) -> None:
            nonlocal n_ids
            at = 0
            for b in batches:
                block = []
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    ids = np.concatenate([np.frombuffer(coder.encode(text), "<u4"), end])
                    record = pack_record(None if pd.isna(doc_id) else int(doc_id), ids, width)
                    places.append((at, n_ids))
                    at, n_ids = at + len(record), n_ids + len(ids)
                    block.append(record)
                out.write(b"".join(block))

        write_atomic(f"{name}.bin", fill)
        write_atomic(f"{name}.idx", lambda out: out.write(np.array(places, "<i8").tobytes()))
        yield pd.DataFrame({"part": [part], "file": [f"{name}.bin"], "n_docs": [len(places)], "n_ids": [n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = write_and_reread(dealt.mapInPandas(write, "part int, file string, n_docs long, n_ids long"), "token-manifest")
    # One row a file, so this window without partitions is over as many rows as there are files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files that the manifest names; every checksum is verified."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, base in zip(b["file"], b["base"], strict=True):
                fs, path = open_fs(file)
                rows, start = [], int(base)
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as source:
                    while record := read_record(source):
                        doc_id, ids = record
                        wide = ids.astype("<u4").tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(wide), *([wide] if with_ids else [])))
                        start += len(ids)
                        if len(rows) >= 500:
                            yield frame(rows)
                            rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])
        return out.astype({"doc_id": "Int64"})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    n = max(1, manifest.count())
    return manifest.select("file", "base").repartition(n).mapInPandas(read, schema)


def read_at(file: str, record: int) -> tuple[int | None, np.ndarray]:
    """One record by its number in the file, found through the offset index: what a shuffled reader does."""
    places = memory_map(file.removesuffix(".bin") + ".idx", "<i8").reshape(-1, 2)
    fs, path = open_fs(file)
    with fs.open_input_file(path) as source:
        source.seek(int(places[record, 0]))
        return read_record(source)
