"""WARC archives with a Zstandard dictionary: one skippable frame with the dictionary, then one frame per record.

Payload digests are computed in Spark. Of rows with equal payloads the one with the smallest page_id is written as a response, the
others as revisits that refer to it. Each task writes archives of about ``archive_bytes`` of records; an archive's dictionary is
trained on records of that archive, evenly spaced and at most ``sample_bytes`` of them (of a longer record the first 128 KB), and stands in its leading skippable frame
(magic 0x184D2A5D), so a reader needs the file only. An archive with too few records to train on has no dictionary frame.

Defined results: a null html is an empty payload; a null url leaves the target header out; rows with a null page_id are written
and read back with a null page_id, and rank last. Rows that repeat the smallest page_id of a payload are all responses. An empty table writes no archive
and reads back empty. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphbatch.llm.common import write_and_reread
from graphbatch.llm.files import open_fs, write_atomic

DICTIONARY_FRAME = 0x184D2A5D
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_roles(pages: DataFrame, min_bytes: int = 0, broadcast_rows: int = 200_000) -> DataFrame:
    """(page_id, url, html, sha1, refers_to, named, refers_named): the smallest page_id with an equal payload, null for responses.

    ``named`` tells whether the page_id alone names the record, ``refers_named`` the same of refers_to. Only (digest, page_id) is shuffled for
    the grouping. The tables of repeated payloads and of repeated ids are then counted: up to ``broadcast_rows`` rows of at most 48 bytes go out by
    broadcast, a larger one joins by shuffle.
    """
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    firsts = known.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    firsts = write_and_reread(firsts, "warc-repeats")
    twice = write_and_reread(known.where("page_id IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("id")), "warc-twice")
    met = lambda table: F.broadcast(table) if table.count() <= broadcast_rows else table
    out = known.join(met(firsts), "sha1", "left")
    out = out.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")
    for column, flag in (("page_id", "named"), ("refers_to", "refers_named")):
        out = out.join(met(twice), F.col(column) == F.col("id"), "left").withColumn(flag, F.col(column).isNotNull() & F.col("id").isNull()).drop("id")
    return out


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _record(name: str, page_id: int | None, url: str | None, html: str, sha1: str, refers_to: int | None, refers_named: bool) -> bytes:
    payload = html.encode("utf-8")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    revisit = refers_to is not None
    block = HTTP_HEAD.format(len(payload)).encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(name)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "%" else f"%{ord(c):02X}" for c in url))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        if refers_named:
            lines.append(f"WARC-Refers-To: {_urn(f'page:{refers_to}')}")
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _train(records: list[bytes], sample_bytes: int, dictionary_bytes: int) -> zstandard.ZstdCompressionDict | None:
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    sample = [r[:131_072] for r in records[::step]]
    try:
        return zstandard.train_dictionary(dictionary_bytes, sample)
    except zstandard.ZstdError:  # too few or too short records
        return None


def write_archives(roles: DataFrame, uri: str, archive_bytes: int = 24 << 20, dictionary_bytes: int = 65_536, sample_bytes: int = 4 << 20, level: int = 6) -> DataFrame:
    """Write the rows of ``record_roles``; returns the manifest (file, n_records, bytes). Record ids are unique: by page_id, or by place where that is null or repeated."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, size, k = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pd.DataFrame:
            file = f"{uri}/part-{part:06d}-{k:05d}.warc.zst"
            trained = _train(held, sample_bytes, dictionary_bytes)
            pack = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)

            def fill(out) -> None:
                if trained is not None:
                    raw = trained.as_bytes()
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
                for r in held:
                    out.write(pack.compress(r))

            return pd.DataFrame({"file": [file], "n_records": [len(held)], "bytes": [write_atomic(file, fill)]})

        for b in batches:
            for row in b.itertuples(index=False):
                whole = lambda x: None if pd.isna(x) else int(x)
                name = f"page:{whole(row.page_id)}" if row.named else f"place:{uri}/{part}/{k}/{len(held)}"
                held.append(_record(name, whole(row.page_id), row.url, row.html, row.sha1, whole(row.refers_to), row.refers_named))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size, k = [], 0, k + 1
        if held:
            yield flush()

    return write_and_reread(roles.select("page_id", "url", "html", "sha1", "refers_to", "named", "refers_named").mapInPandas(write, "file string, n_records long, bytes long"), "warc-manifest")


def iterate_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an opened archive; the dictionary comes from its leading frame."""
    start = source.read(8)
    if not start:
        return
    trained, rest = None, start
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_FRAME:
        trained, rest = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", start[4:])[0])), b""
    unpack = zstandard.ZstdDecompressor(dict_data=trained)
    while True:
        frame, out = unpack.decompressobj(), []
        while not frame.eof:
            rest = rest or source.read(1 << 18)
            if not rest:
                if out:
                    raise ValueError("archive ends inside a record")
                return
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        head, _, body = b"".join(out).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield headers, body[: int(headers["Content-Length"])]


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows of the records in the archives; a response's digest and length are recomputed from its payload and checked."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"]:
                fs, path = open_fs(file)
                rows = []
                with fs.open_input_stream(path, compression=None) as source:
                    for h, block in iterate_records(source):
                        digest, size, payload = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), None
                        if h["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
                        url = h.get("WARC-Target-URI")
                        rows.append((int(h["X-Page"]) if "X-Page" in h else None, url and _unquote(url), size, digest, h["WARC-Type"], int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None, *([payload] if with_payload else [])))
                        if len(rows) >= 1000:
                            yield frame(rows)
                            rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return manifest.select("file").repartition(max(1, manifest.count())).mapInPandas(read, READ_SCHEMA + ", payload binary" * with_payload)


def _unquote(url: str) -> str:
    head, *rest = url.split("%")
    return head + "".join(chr(int(x[:2], 16)) + x[2:] for x in rest)
