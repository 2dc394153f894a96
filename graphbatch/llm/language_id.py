"""Language identification: one interpolated Kneser-Ney model of characters a language, kept in sorted hash arrays.

Texts are read as lower-cased letters (with their marks) and single spaces, led by ``order - 1`` pads. Spark counts the runs of ``order``
characters of all labelled texts; shorter orders count distinct left contexts, so they follow from the longer ones by grouping. Each model has,
per run it saw, the logarithm of its interpolated probability, and per context the logarithm of the weight of the next shorter
order. Both lie in one array a language and shard, sorted by a 64-bit hash, which tasks map into memory and search by bisection.

A text goes to the language of the lowest cross-entropy per character. Labelled texts that were left out of the counts calibrate a temperature (which
turns entropies into a score) and, per language, the entropy above which a text is rejected as none of the known ones.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphbatch.llm.common import scratch_path, write_and_reread
from graphbatch.llm.files import memory_map, write_atomic
from graphbatch.llm.shingles import MIX_1, STEP, _finish

ORDER = 5
UNKNOWN = "und"
SPACE, PAD = 32, 2
#: Characters that one step of a task holds as arrays; longer texts are read in pieces.
PIECE = 1 << 20
#: Of labelled texts at most this share, and about this number, calibrates instead of being counted.
CALIBRATION_SHARE, CALIBRATION_ROWS = 1 / 16, 20_000
#: Languages of fewer labelled texts calibrate nothing.
CALIBRATION_LEAST = 32


@functools.cache
def _read_as() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: what it is read as, and whether it is a letter."""
    read, letter = np.full(0x110000, SPACE, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            read[c], letter[c] = ord(low) if len(low) == 1 else c, True
        elif unicodedata.category(ch)[0] == "M":
            read[c] = c
    return read, letter


def _pieces(text: str, order: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Code points as read, each piece led by the ``order - 1`` before it, and whether the piece has letters."""
    (read, letter), tail = _read_as(), np.full(order - 1, PAD, np.uint32)
    for at in range(0, len(text), PIECE):
        raw = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        x = read[raw]
        keep = x != SPACE
        keep[1:] |= x[:-1] != SPACE
        keep[0] |= not len(tail) or tail[-1] != SPACE
        x = np.concatenate([tail, x[keep]])
        yield x, bool(letter[raw].any())
        tail = x[len(x) - order + 1 :]


def _hash(columns: list[np.ndarray], salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0]) if columns else 1, salt, np.uint64) * MIX_1  # far apart, or a salt could make up for a character
        for c in columns:
            h = (h + c.astype(np.uint64)) * STEP
            h ^= h >> np.uint64(32)
        return _finish(h).view(np.int64)


def _key(columns: list[np.ndarray], order: int, context: bool) -> np.ndarray:
    """Hash of runs of one order, or of contexts of that order, which are one shorter."""
    return _hash(columns, 2 * order + context + 1)


@dataclass
class Windows:
    """Runs of ``order`` characters of several texts: code points, where each run starts, and the text it belongs to."""

    points: np.ndarray
    starts: np.ndarray
    owner: np.ndarray

    def distinct(self, order: int, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(code of each run, place of the first run of each code); runs of owners with another ``by`` are told apart."""
        h = _hash([self.points[j : len(self.points) - order + 1 + j] for j in range(order)], 1)[self.starts]
        if by is not None:
            with np.errstate(over="ignore"):
                h = h + (by[self.owner].astype(np.uint64) * STEP).view(np.int64)
        codes, seen = pd.factorize(h)
        first = np.zeros(len(seen), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        return codes, first

    def runs(self, places: np.ndarray, order: int) -> np.ndarray:
        return self.points[self.starts[places][:, None] + np.arange(order)]


def windows_of(texts: list[str | None], order: int, letters: np.ndarray) -> Iterator[Windows]:
    """All runs of all texts, about ``PIECE`` at a time; ``letters`` is told which texts have any letter."""
    held: list[np.ndarray] = []
    owners: list[int] = []

    def frame() -> Windows:
        sizes = np.array([len(x) - order + 1 for x in held])
        points = np.concatenate(held)
        begins = np.concatenate([[0], np.cumsum(sizes + order - 1)[:-1]])
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return Windows(points, np.repeat(begins, sizes) + inner, np.repeat(np.array(owners), sizes))

    total = 0
    for k, text in enumerate(texts):
        for x, has in _pieces(text or "", order):
            letters[k] |= has
            held.append(x)
            owners.append(k)
            total += len(x)
            if total >= PIECE:
                yield frame()
                held, owners, total = [], [], 0
    if held:
        yield frame()


def count_runs(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, c): how often each run of ``order`` characters is in the texts of each language; tasks send distinct runs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, codes = np.unique(b["lang"].to_numpy(str), return_inverse=True)
            for w in windows_of(b["text"].tolist(), order, np.zeros(len(b), bool)):
                code, first = w.distinct(order, codes + 1)
                if len(first):
                    grams = np.ascontiguousarray(w.runs(first, order)).view(f"<U{order}").ravel()
                    yield pd.DataFrame({"lang": names[codes[w.owner[first]]], "gram": grams.tolist(), "c": np.bincount(code)})

    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    return known.mapInPandas(count, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, context, text, value) of the interpolated models: log-probabilities of runs of 1 to ``order`` characters, and log-weights of contexts.

    P_k(c | h) = max(count - D, 0) / total(h) + D types(h) / total(h) P_{k-1}(c | h'), down to one share for each known character and one for
    all others. D = n1 / (n1 + 2 n2) from the runs seen once and twice, per language and order, kept within 0.1 and 0.9. A context
    is followed by as many kinds as there are characters at most, so no group grows with the texts.
    """
    of, parts = counts, []
    for k in range(order, 0, -1):
        parts.append(of.select("lang", F.lit(k).alias("k"), "gram", "c"))
        of = of.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("c"))
    runs = write_and_reread(functools.reduce(DataFrame.unionByName, parts).withColumn("head", F.expr("substring(gram, 1, k - 1)")), "lm-runs")
    once, twice = (F.count(F.when(F.col("c") == n, 1)) for n in (1, 2))
    share = F.when(once > 0, once / (once + 2 * twice)).otherwise(0.75)
    discount = runs.groupBy("lang", "k").agg(F.least(F.greatest(share, F.lit(0.1)), F.lit(0.9)).alias("d"))
    same = Window.partitionBy("lang", "k", "head")
    told = runs.withColumns({"total": F.sum("c").over(same), "types": F.count("*").over(same)}).join(discount, ["lang", "k"])
    alpha, gamma = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total"), F.col("d") * F.col("types") / F.col("total")
    told = write_and_reread(told.select("lang", "k", "gram", "head", alpha.alias("alpha"), gamma.alias("gamma")), "lm-shares")
    known = runs.where("k = 1").select("gram").distinct().count()
    p, levels = None, []
    for k in range(1, order + 1):
        here = told.where(F.col("k") == k)
        if p is None:
            p = here.select("lang", "gram", (F.col("alpha") + F.col("gamma") / (known + 1)).alias("p"))
        else:
            shorter = p.select("lang", F.col("gram").alias("rest"), F.col("p").alias("q"))
            p = here.withColumn("rest", F.substring("gram", 2, k - 1)).join(shorter, ["lang", "rest"]).select("lang", "gram", (F.col("alpha") + F.col("gamma") * F.col("q")).alias("p"))
        levels.append(p.select("lang", F.lit(k).alias("k"), F.lit(False).alias("context"), F.col("gram").alias("text"), F.log("p").alias("value")))
    contexts = told.groupBy("lang", "k", "head").agg(F.log(F.first("gamma")).alias("value"))
    levels.append(contexts.select("lang", "k", F.lit(True).alias("context"), F.col("head").alias("text"), "value"))
    rest = counts.select("lang").distinct().select("lang", F.lit(0).alias("k"), F.lit(False).alias("context"), F.lit("").alias("text"), F.log(F.lit(1.0 / (known + 1))).alias("value"))
    return functools.reduce(DataFrame.unionByName, [*levels, rest])


def write_arrays(entries: DataFrame, uri: str, shard_rows: int = 4_000_000) -> tuple[list[str], int]:
    """Write a model's entries as sorted arrays of hashes and values, one pair of files a language and shard. Returns languages and shards."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (k, context), part in b.groupby(["k", "context"]):
                n = int(k) - int(context)
                points = np.array(part["text"].tolist(), f"<U{n}").view(np.uint32).reshape(len(part), n) if n > 0 else np.zeros((len(part), 0), np.uint32)
                keys = np.broadcast_to(_key(list(points.T), int(k), bool(context)), len(part))
                yield pd.DataFrame({"lang": part["lang"].to_numpy(), "digest": keys, "value": part["value"].to_numpy()})

    rows = write_and_reread(entries.mapInPandas(hashed, "lang string, digest long, value double"), "lm-hashed")
    n = max(1, -(-rows.count() // shard_rows))
    shard = F.least(F.lit(n - 1), F.floor((F.col("digest") / F.lit(2.0**64) + 0.5) * n)).cast("int")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list[pd.DataFrame]] = {}

        def flush(at: tuple[str, int]) -> pd.DataFrame:
            b = pd.concat(held.pop(at))
            for name, data in (("keys", b["digest"].to_numpy("<i8")), ("values", b["value"].to_numpy("<f8"))):
                write_atomic(_file(uri, *at, name), lambda out, data=data: out.write(data.tobytes()))
            return pd.DataFrame({"lang": [at[0]], "shard": [at[1]]})

        for b in batches:  # sorted, so a shard is whole when the next one begins
            for at, part in b.groupby(["lang", "shard"]):
                for done in [x for x in held if x != at]:
                    yield flush(done)
                held.setdefault(at, []).append(part)
        for done in list(held):
            yield flush(done)

    written = rows.withColumn("shard", shard).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "digest").mapInPandas(write, "lang string, shard int").collect()
    langs, present = sorted({r["lang"] for r in written}), {(r["lang"], r["shard"]) for r in written}
    for at in {(lang, k) for lang in langs for k in range(n)} - present:
        for name in ("keys", "values"):
            write_atomic(_file(uri, *at, name), lambda out: out.write(b""))
    return langs, n


def _file(uri: str, lang: str, shard: int, name: str) -> str:
    return f"{uri}/{hashlib.md5(lang.encode()).hexdigest()}-{shard:05d}.{name}"


@dataclass(frozen=True)
class LanguageModels:
    """What scoring needs besides the files: languages in order, temperature, and per language (mean, limit) of the entropy of its own texts."""

    uri: str
    langs: tuple[str, ...]
    shards: int
    order: int = ORDER
    temperature: float = 1.0
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)


class Arrays:
    """Reader of a model's files; opened once a process."""

    _open: dict[str, "Arrays"] = {}

    def __init__(self, models: LanguageModels):
        self.order = models.order
        self.arrays = [[(memory_map(_file(models.uri, lang, k, "keys"), "<i8"), memory_map(_file(models.uri, lang, k, "values"), "<f8")) for k in range(models.shards)] for lang in models.langs]

    @classmethod
    def cached(cls, models: LanguageModels) -> "Arrays":
        if models.uri not in cls._open:
            cls._open[models.uri] = cls(models)
        return cls._open[models.uri]

    def find(self, lang: int, keys: np.ndarray) -> np.ndarray:
        """The value of each key; not a number where there is none."""
        out, shards = np.full(len(keys), np.nan), self.arrays[lang]
        place = np.minimum(len(shards) - 1, np.floor((keys / 2.0**64 + 0.5) * len(shards)).astype(np.int64)) if len(shards) > 1 else None
        for k, (stored, values) in enumerate(shards):
            mine = slice(None) if place is None else np.flatnonzero(place == k)
            if len(stored):
                at = np.minimum(np.searchsorted(stored, keys[mine]), len(stored) - 1)
                out[mine] = np.where(stored[at] == keys[mine], values[at], np.nan)
        return out

    def log_probabilities(self, runs: np.ndarray) -> list[np.ndarray]:
        """Per language the log-probability of each run's last character after the others: the longest known run, and the weights of longer known contexts."""
        n, out = self.order, []
        last = {k: _key([runs[:, j] for j in range(n - k, n)], k, False) for k in range(1, n + 1)}
        before = {k: _key([runs[:, j] for j in range(n - k, n - 1)], k, True) for k in range(2, n + 1)}
        before[1] = np.repeat(_key([], 1, True), len(runs))
        for lang in range(len(self.arrays)):
            total, open_ = np.zeros(len(runs)), np.arange(len(runs))
            for k in range(n, 0, -1):
                found = self.find(lang, last[k][open_])
                hit = ~np.isnan(found)
                total[open_[hit]] += found[hit]
                open_ = open_[~hit]
                if not len(open_):
                    break
                total[open_] += np.nan_to_num(self.find(lang, before[k][open_]))
            else:
                total[open_] += self.find(lang, _key([], 0, False))[0]
            out.append(total)
        return out


def cross_entropies(texts: DataFrame, models: LanguageModels, keep: list[str]) -> DataFrame:
    """The columns ``keep``, then length (characters as read), letters, and entropies (nats a character, in the order of the languages)."""
    n_langs, order = len(models.langs), models.order
    kept = texts.select(F.struct(*keep).alias("row"), F.col("text").alias("text"))
    kind = pa.schema([("length", pa.int64()), ("letters", pa.bool_()), ("entropies", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays.cached(models)
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                said = b.column("text").to_pylist()
                letters, length, sums = np.zeros(len(said), bool), np.zeros(len(said), np.int64), np.zeros((n_langs, len(said)))
                for w in windows_of(said, order, letters):
                    codes, first = w.distinct(order)
                    length += np.bincount(w.owner, minlength=len(said))
                    for k, logs in enumerate(arrays.log_probabilities(w.runs(first, order))):
                        sums[k] += np.bincount(w.owner, logs[codes], minlength=len(said))
                each = (-sums / np.maximum(length, 1)).T
                columns = [pa.array(length), pa.array(letters), pa.array(each.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([b.column("row"), *columns], names=["row", *kind.names])

    out = kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, length long, letters boolean, entropies array<double>")
    return out.select("row.*", "length", "letters", "entropies")


def calibrate(models: LanguageModels, labelled: DataFrame, quantile: float = 0.99) -> LanguageModels:
    """Temperature and limits from labelled texts that weren't counted; they are few (``CALIBRATION_ROWS``), and only numbers of them come to the driver."""
    at = {lang: k for k, lang in enumerate(models.langs)}
    rows = [r for r in cross_entropies(labelled.where(F.col("lang").isin(list(at))), models, ["lang"]).where("letters").select("lang", "length", "entropies").collect()] if at else []
    if not rows:
        return models
    each, length, truth = np.array([r["entropies"] for r in rows]), np.array([r["length"] for r in rows]), np.array([at[r["lang"]] for r in rows])

    def likelihood(t: float) -> float:
        z = -t * np.sqrt(length)[:, None] * (each - each.min(1, keepdims=True))
        return float((z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).sum())

    best, limits = max(np.logspace(-2, 2, 41), key=likelihood), {}
    for lang, k in at.items():
        own, root = each[truth == k, k], np.sqrt(length[truth == k])
        if len(own) >= 20:
            mean = float(np.average(own, weights=root**2))
            limits[lang] = mean, float(np.quantile((own - mean) * root, quantile))
    return LanguageModels(models.uri, models.langs, models.shards, models.order, float(best), limits)


def train(labelled: DataFrame, key: Column, order: int = ORDER) -> LanguageModels:
    """Models of (text, lang) rows; rows without either teach nothing. ``key`` says, by its hash, which rows calibrate.

    All rows are counted but those that calibrate: of languages with 32 rows or more a sixteenth, or less where that would be more than
    about 20,000 in all. Without any labelled text there are no models, and every text is of an unknown language.
    """
    spark = labelled.sparkSession
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", (F.xxhash64(key) / F.lit(2.0**64) + 0.5).alias("u"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    many = sorted(lang for lang, n in sizes.items() if n >= CALIBRATION_LEAST)
    share = min(CALIBRATION_SHARE, CALIBRATION_ROWS / max(1, sum(sizes.values())))
    left_out = F.col("lang").isin(many) & (F.col("u") < share) if many else F.lit(False)
    counts = write_and_reread(count_runs(known.where(~left_out), order), "lm-counts")
    uri = scratch_path(spark, "language-models")
    langs, shards = write_arrays(kneser_ney(counts, order), uri)
    return calibrate(LanguageModels(uri, tuple(langs), shards, order), known.where(left_out))


def identify(texts: DataFrame, models: LanguageModels, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row, then lang_pred, score, cross_entropy, rejected.

    ``lang_pred`` is the language of the lowest entropy (the first by name where several are equal), ``und`` with score 0 for texts that are null or have no
    letter, and for all texts if no language was learned. ``score`` is the softmax of the entropies, scaled by the root of the length and the calibrated
    temperature. ``rejected`` says that the text fits the best language worse than 99 in 100 calibrating texts of that language did, its length
    considered; languages with fewer than 20 of those reject nothing. Empty tables give empty results; repeated rows are scored one by one.
    Columns of the input that aren't kept may have any name.
    """
    each = cross_entropies(texts, models, keep)
    known = F.col("letters") & F.lit(bool(models.langs))
    place = F.array_position("entropies", F.array_min("entropies")).cast("int")
    names = F.array(*map(F.lit, models.langs)) if models.langs else F.array(F.lit(UNKNOWN))
    least = F.array_min("entropies")
    soft = 1 / F.aggregate("entropies", F.lit(0.0), lambda s, e: s + F.exp(F.lit(-models.temperature) * F.sqrt("length") * (e - least)))
    limit = lambda k: F.element_at(F.array(*(F.lit(float(models.limits.get(lang, (0.0, np.inf))[k])) for lang in models.langs or ("",))), place)
    rejected = (least - limit(0)) * F.sqrt("length") > limit(1)
    return each.select(
        *keep,
        F.when(known, F.element_at(names, place)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, soft).otherwise(0.0).alias("score"),
        F.when(known, least).alias("cross_entropy"),
        F.when(known, rejected).otherwise(True).alias("rejected"),
    )


def predicted_languages(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) of every document; those of the held-out fold of crc32(doc_id) teach nothing.

    Documents without an id are never held out.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    models = train(docs.where(~held_out).select("text", "lang", "doc_id"), F.col("doc_id"))
    out = identify(docs.select("doc_id", "text"), models, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
