"""BPE encoding and decoding through a table of distinct words.

1. Spark splits every text into the tokenizer's words, once. Each task numbers the distinct words of a slice of about ``slice_words`` words of
   whole texts, in order of a hash bucket of the word. A slice is one row of such numbers; its distinct words go out in one row a bucket.
2. The words of a bucket meet in one group, each distinct one is encoded once with the tokenizers library, and the ids go back to the slices.
   The number of buckets grows with the texts, so that a group holds about ``bucket_chars`` characters' share of words; a word that all texts hold is
   one word a slice, so no bucket is hot.
3. Slices and ids are joined by slice; within it a word's number is its position among the ids. Slices are written bucketed, so only ids move.
4. Decoding joins the distinct ids of each slice of texts to their pieces in the tokenizer's id-to-piece table (50,257 rows for the default,
   by broadcast, so nothing is shuffled) and puts each text together from the pieces of its slice.

Tokenizers with byte-level BPE, no normalizer and no added prefix space are supported; others are refused. Added tokens in
a text (``<|endoftext|>``) are words of their own, as in the library.

Defined results: a null text counts as empty; an empty text has no ids. Rows are told apart by their place in a slice, so repeated
or null ids are no matter. A decoded text equals the original. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbatch.functions.lineage import write_bucketed
from graphbatch.llm.common import slices

#: Below this code point the letter and number classes are the same in all Unicode versions in use.
SAFE_END = 0x530


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _class_body(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SAFE_END) if unicodedata.category(chr(c))[0] == kind)


class WordCoder:
    """Splits texts into the tokenizer's words and encodes words; one per process and tokenizer file.

    Texts of plain letters, digits and marks below U+0530 are split by an equal ``re`` pattern, which is several times faster; any
    other text is split by the library itself.
    """

    _open: dict[str, "WordCoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer and prefix space can be encoded word by word")
        added = [t for t in spec["added_tokens"] if t["content"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that strip or match whole words only can't be encoded word by word")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None
        self.added_words = {t["content"] for t in added}
        letters, numbers, space = _class_body("L"), _class_body("N"), r"\t-\r \x85\xa0"
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.unsafe = re.compile(r"[^\x00-\x1b\x20-" + chr(SAFE_END - 1) + "]")
        self.cache: OrderedDict[str, bytes] = OrderedDict()

    @classmethod
    def cached(cls, path: str) -> "WordCoder":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _split_plain(self, text: str) -> list[str]:
        if self.unsafe.search(text) is None:
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.added is None or self.added.search(text) is None:
            return self._split_plain(text)
        return [w for part in self.added.split(text) if part for w in ([part] if part in self.added_words else self._split_plain(part))]

    def encode_words(self, words: list[str], chunk: int = 4000) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers; many words are one call of the library, which tells whose each id is."""
        out: list[bytes] = []
        for k in range(0, len(words), chunk):
            part = words[k : k + chunk]
            encoded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.asarray(encoded.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.asarray(encoded.word_ids, np.int64), np.arange(len(part)), side="right")).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def encode(self, text: str | None, limit: int = 1_500_000) -> bytes:
        """Ids of a whole text; words are encoded when first met and kept, up to ``limit`` words in this process."""
        words = self.split(text)
        known = list(map(self.cache.get, words))
        if None in known:
            new = list({w for w, k in zip(words, known, strict=True) if k is None})
            fresh = dict(zip(new, self.encode_words(new), strict=True))
            known = [fresh[w] if k is None else k for w, k in zip(words, known, strict=True)]
            if len(self.cache) + len(fresh) > limit:
                self.cache.clear()
            self.cache.update(fresh)
        return b"".join(known)

    @property
    def width(self) -> int:
        """Bytes that hold any id."""
        return 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def narrow(self, raw: list[bytes]) -> list[bytes]:
        """Ids of four bytes each as ids of ``width`` bytes."""
        return _recoded(raw, 4, self.width)

    def wide(self, raw: list[bytes]) -> list[bytes]:
        return _recoded(raw, self.width, 4)

    def pieces(self) -> list[bytes]:
        """The bytes of each id: the id-to-piece table."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        out = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for piece, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[k] = piece.encode() if piece in self.added_words else bytes(back[c] for c in piece)
        return out


def _recoded(raw: list[bytes], width: int, to: int) -> list[bytes]:
    """Little-endian numbers of ``width`` bytes each as such of ``to`` bytes, all lists in one pass."""
    if width == to or not raw:
        return raw
    ends = np.cumsum(np.fromiter(map(len, raw), "<i8", len(raw)) // width * to).tolist()
    flat = np.frombuffer(b"".join(raw), f"<u{width}").astype(f"<u{to}").tobytes()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Numbers(dict):
    """Numbers for keys in the order of their first use."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), "<u4", len(keys))


def pack_numbers(x: np.ndarray) -> bytes:
    """Compressed by planes of equal bytes, since most numbers are small."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4).T).tobytes(), 3)


def unpack_numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), "u1").reshape(4, -1).T).view("<u4").ravel()


def pack_strings(items: list[bytes], width: int = 1) -> bytes:
    """Count, bytes a size, sizes (in units of ``width`` bytes), and all bytes one after the other."""
    sizes = np.fromiter(map(len, items), "<u4", len(items)) // width
    each = 1 if sizes.max(initial=0) < 256 else 4
    return zstandard.compress(len(items).to_bytes(4, "little") + bytes([each]) + sizes.astype(f"<u{each}").tobytes() + b"".join(items), 6)


def unpack_strings(blob: bytes, width: int = 1) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n, each = int.from_bytes(raw[:4], "little"), raw[4]
    start = 5 + each * n
    ends = (start + width * np.cumsum(np.frombuffer(raw, f"<u{each}", n, 5), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([start, *ends], ends, strict=False)]


def sliced(rows: DataFrame, path: str, slice_words: int, buckets: int) -> DataFrame:
    """Slices of whole rows (id string, text): one row (slice, ids, counts, blob of numbers) each, and one (slice, bucket, blob of words) for each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, number = WordCoder.cached(path), TaskContext.get().partitionId() << 32
        known, ids, codes, size = Numbers(), [], [], 0

        def close() -> Iterator[pd.DataFrame]:
            words = [w.encode() for w in known]
            # Sorted words, and the ids of sorted words, compress much better.
            placed = sorted((xxhash.xxh64_intdigest(w) % buckets, w, k) for k, w in enumerate(words))
            bucket, order = np.array([b for b, _, _ in placed], "i8"), np.array([k for _, _, k in placed], "i8")
            rank = np.empty(len(words), "<u4")
            rank[order] = np.arange(len(words))
            counts = pack_numbers(np.fromiter(map(len, codes), "<u4", len(codes)))
            yield pd.DataFrame({"slice": number, "bucket": pd.array([None], "Int32"), "ids": [ids], "counts": [counts], "blob": [pack_numbers(rank[np.concatenate(codes)])]})
            present, starts = np.unique(bucket, return_index=True)
            blobs = [pack_strings([words[k] for k in part.tolist()]) for part in np.split(order, starts[1:])] if len(present) else []
            yield pd.DataFrame({"slice": number, "bucket": present.astype("i4"), "ids": None, "counts": None, "blob": blobs})

        for b in slices(batches):
            for key, text in zip(b["id"], b["text"], strict=True):
                words = coder.split(text)
                ids.append(key), codes.append(known.of(words))
                size += len(words)
                if size >= slice_words or len(ids) >= slice_words:
                    yield from close()
                    number, known, ids, codes, size = number + 1, Numbers(), [], [], 0
        if ids:
            yield from close()

    return rows.mapInPandas(run, "slice long, bucket int, ids array<string>, counts binary, blob binary")


def encode_buckets(words: DataFrame, path: str) -> DataFrame:
    """(slice, bucket, blob of ids in the order of the words) from (slice, bucket, blob of words): each distinct word of a bucket is encoded once."""

    def encode(g: pd.DataFrame) -> pd.DataFrame:
        table, coder = Numbers(), WordCoder.cached(path)
        asked = [table.of(unpack_strings(x)) for x in g["blob"]]
        raw = coder.narrow(coder.encode_words([w.decode() for w in table]))
        return g[["slice", "bucket"]].assign(blob=[pack_strings([raw[k] for k in x.tolist()], coder.width) for x in asked])

    return words.groupBy("bucket").applyInPandas(encode, "slice long, bucket int, blob binary")


def encode_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    slice_words: int = 1_000_000,
    bucket_chars: int = 4_000_000,
    digests_only: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, ids binary) per row; with ``digests_only`` (doc_id, n_tokens, ids_sha256, decoded_sha256) instead."""
    path, id_type = tokenizer_path or default_tokenizer(), dict(docs.dtypes)[id_col]
    WordCoder.cached(path)  # refuses other tokenizers at once
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    cut = write_bucketed(sliced(rows, path, slice_words, max(1, -(-chars // bucket_chars))), "bpe_slices", "slice", shuffle=False)
    own = cut.where(F.col("bucket").isNull()).select("slice", "ids", "counts", "blob")
    found = encode_buckets(cut.where(F.col("bucket").isNotNull()).select("slice", "bucket", "blob"), path)
    found = found.select(F.col("slice").alias("of"), "bucket", "blob")

    def whole(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[str | None, bytes]]:
        coder = WordCoder.cached(path)
        table = coder.wide([x for blob in right.sort_values("bucket")["blob"] for x in unpack_strings(blob, coder.width)])
        row = left.iloc[0]
        ends, codes = np.cumsum(unpack_numbers(row["counts"]), dtype=np.int64).tolist(), unpack_numbers(row["blob"])
        for key, a, b in zip(row["ids"], [0, *ends], ends, strict=False):
            yield key, b"".join(map(table.__getitem__, codes[a:b].tolist()))

    def with_ids(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(whole(left, right)), columns=["doc_id", "ids"])
        return out.assign(n_tokens=out["ids"].map(len) // 4)[["doc_id", "n_tokens", "ids"]]

    joined = own.groupBy("slice").cogroup(found.groupBy("of"))
    if not digests_only:
        return joined.applyInPandas(with_ids, "doc_id string, n_tokens long, ids binary").withColumn("doc_id", F.col("doc_id").cast(id_type))

    def with_units(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return slice_of_ids(*zip(*whole(left, right), strict=True))

    def digests(keys: list, raw: list[bytes], texts: list[bytes]) -> pd.DataFrame:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        back = (x.decode("utf-8", "replace").encode() for x in texts)
        return pd.DataFrame({"doc_id": keys, "n_tokens": [len(x) // 4 for x in raw], "ids_sha256": list(map(sha, raw)), "decoded_sha256": list(map(sha, back))})

    out = with_pieces(joined.applyInPandas(with_units, SLICE_OF_IDS), path, digests, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the tokenizer's vocabulary, a table of fixed size."""
    return spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(WordCoder.cached(path).pieces())], "id int, piece binary")


SLICE_OF_IDS = "keys array<string>, raw binary, id int"


def slice_of_ids(keys, raw) -> pd.DataFrame:
    """One row with the texts' ids, then one for each distinct id of them in rising order."""
    units = np.unique(np.frombuffer(b"".join(raw), "<i4"))
    head = {"keys": list(keys), "raw": pack_strings(list(raw)), "id": None}
    return pd.DataFrame([head, *({"keys": None, "raw": None, "id": k} for k in units.tolist())]).astype({"id": "Int32"})


def with_pieces(rows: DataFrame, path: str, finish, schema: str) -> DataFrame:
    """Each id of the slices joined to its piece; ``finish(keys, ids of each text, bytes of each text)`` makes a slice's rows.

    The join is by broadcast, so the rows of a slice stay together behind their head; a missing or displaced one is an error.
    """
    each = rows.join(F.broadcast(piece_table(rows.sparkSession, path)), "id", "left").select("keys", "raw", "id", "piece")  # as many rows as the vocabulary has

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, units, pieces = None, [], []

        def close() -> pd.DataFrame:
            keys, blob = head
            raw, known = unpack_strings(blob), np.concatenate([*units, np.zeros(0, "i4")]).astype("i4")
            places = [np.searchsorted(known, np.frombuffer(x, "<i4")) for x in raw]
            if (np.diff(known) <= 0).any() or any((p >= len(known)).any() or (known[p] != np.frombuffer(x, "<i4")).any() for p, x in zip(places, raw, strict=True)):
                raise RuntimeError("the pieces of a slice are not all behind its head")
            return finish(list(keys), raw, [b"".join(map(pieces.__getitem__, p.tolist())) for p in places])

        for b in batches:
            starts = np.flatnonzero(b["id"].isna().to_numpy()).tolist()
            for s, e in zip([0, *starts], [*starts, len(b)], strict=True):
                if s in starts and (e > s):
                    if head is not None:
                        yield close()
                    head, units, pieces = (b["keys"].iloc[s], b["raw"].iloc[s]), [], []
                    s += 1
                units.append(b["id"].iloc[s:e].to_numpy("i4"))
                pieces += b["piece"].iloc[s:e].tolist()
        if head is not None:
            yield close()

    return each.mapInPandas(run, schema)


def decode_ids(encoded: DataFrame, tokenizer_path: str | None = None, slice_ids: int = 2_000_000) -> DataFrame:
    """(doc_id, text) from (doc_id, ids binary): ids joined to pieces, read as UTF-8 with the library's replacement marks."""
    path, id_type = tokenizer_path or default_tokenizer(), dict(encoded.dtypes)["doc_id"]

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, raw, size = [], [], 0
        for b in slices(batches):
            for key, ids in zip(b["doc_id"], b["ids"], strict=True):
                keys.append(key), raw.append(ids or b"")
                size += len(raw[-1]) // 4
                if size >= slice_ids or len(keys) >= slice_ids:
                    yield slice_of_ids(keys, raw)
                    keys, raw, size = [], [], 0
        if keys:
            yield slice_of_ids(keys, raw)

    def texts(keys: list, raw: list[bytes], found: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": keys, "text": [x.decode("utf-8", "replace") for x in found]})

    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(units, SLICE_OF_IDS)
    return with_pieces(rows, path, texts, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(id_type))
