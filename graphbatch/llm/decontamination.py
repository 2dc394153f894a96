"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

Texts and items are words (A-Z lower-cased). For each item length a window of as many words starts at every word of a text.

1. Filters that lose no item. An item of ``n`` words held within ``k`` word edits lies in at most n + k words and shares at least n - 1 - 2k
   of its word pairs with them (each edit breaks two); the stretch can be taken to begin with one of the item's first k + 1 words,
   unchanged, since a first word that differs counts no more when it is left out. Hashed pairs of all items form a bitmap of fixed size;
   prefix sums of its hits over a text give the count of the n + k words from every start, the inside of a run of one pair left out.
   Of the starts that pass, those stay whose words share as many pairs with the items of one of 64 groups (a mask a pair, also of fixed size)
   that has items of this length, and that begin with such a first word (a bitmap of words and lengths).
2. CGK embedding. A random walk reads the window's words, writes one word a step and moves on by a hashed random bit, so windows within a
   few edits fall into step again and write mostly equal words: edit distance becomes Hamming distance.
3. Bit-sampling LSH. Each repetition has a walk of its own and samples ``bits`` of its steps as the key. Items have keys from each
   of their first k + 1 words on, so that the one from which a window starts meets it in step; added or lost words put them out of it later on, so
   steps are drawn more densely near the begin. The number of repetitions is set for
   each item length so that items edited at the full allowed rate still meet themselves with ``target_recall``, whichever kind of edit it is: replaced,
   added and lost words are simulated each by itself on at most 16 items a length, and the worst counts. Where that would take more than 256
   repetitions, keys are of one step.
   Equal windows are embedded once, however many texts hold them.
4. Least word edit distance of the item and any stretch of the window widened by ``k`` words on either side, exactly.

Defined results: null and empty texts or items match nothing; ``min_words`` leaves shorter items out (none by default; items of up to four
words allow no edit and are met by equal words). Repeated rows and items are matched once each by id. A text shorter than an item by at most
the allowed edits is one window. A row without an id is found with a null doc_id, but can't be named and stays in ``drop_leaks``. Empty tables
give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphbatch.llm.common import slices, write_and_reread
from graphbatch.llm.shingles import word_hashes, words_of_text

BITMAP_BITS, PART_BITS = 1 << 24, 1 << 16
MASK_SHIFT = 4  # masks of item groups are kept for every 16 bits of the bitmap
PAD = np.uint64(0)
#: Power by which sampled steps crowd towards the window's begin.
EARLY = 3
KINDS = ("replaced", "added", "lost")


def allowed_edits(n: int, percent: int) -> int:
    return n * percent // 100


def word_pairs(h: np.ndarray) -> np.ndarray:
    """Place in the bitmap of each pair of neighbouring words."""
    with np.errstate(over="ignore"):
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.int64)


class CgkSampler:
    """Keys of windows of one length: ``repetitions`` walks, each sampled at ``bits`` steps."""

    def __init__(self, repetitions: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, self.repetitions = bits, repetitions
        self.salts = rng.integers(1, 1 << 63, repetitions, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.picks = rng.random((repetitions, bits)) ** EARLY

    def keys(self, windows: np.ndarray, repetitions: int | None = None, bits: int | None = None) -> np.ndarray:
        """``windows``: (count, n) word hashes; returns (count, repetitions) 64-bit keys, of the first repetitions and bits only if told."""
        count, n = windows.shape
        repetitions = repetitions or self.repetitions
        padded = np.column_stack([windows, np.full(count, PAD)])
        rows = np.arange(count)
        out = np.empty((count, repetitions), np.uint64)
        with np.errstate(over="ignore"):
            for r in range(repetitions):
                # A walk moves every other step on average; sampling within 2n steps keeps to the window.
                steps = np.unique((self.picks[r][: bits or self.bits] * 2 * n).astype(np.int64))
                key = np.full(count, np.uint64(r * 1_000_003 + n), np.uint64)
                at = np.zeros(count, np.int64)
                for step in range(int(steps[-1]) + 1):
                    word = padded[rows, at]
                    if step in steps:
                        key = (key ^ word) * np.uint64(0x94D049BB133111EB)
                        key ^= key >> np.uint64(31)
                    move = (word ^ np.uint64(step)) * self.salts[r]
                    at = np.minimum(at + ((move ^ (move >> np.uint64(33))) * self.salts[r] >> np.uint64(63)).astype(np.int64), n)
                out[:, r] = key
        return out


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Word edit distance, or ``most`` + 1 if it is larger; only the band of that width is filled."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new) > most:
            return far
        row = new
    return min(row[-1], far)


def held_edits(item: list[int], words: list[int]) -> int:
    """Least word edit distance of the item and any stretch of ``words`` (Myers' bit vectors; both ends are free)."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    up, down, score, best = full, 0, m, m
    for w in words:
        eq = places.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(xh | up)) & full, up & xh
        score += 1 if plus & high else -1 if minus & high else 0
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(xv | plus)) & full, plus & xv
        best = min(best, score)
    return best


def from_word(h: np.ndarray, at: int) -> np.ndarray:
    """``h`` from a word on, filled up to its length."""
    return np.pad(h[at:], (0, min(at, len(h))))


def _simulated_edits(h: np.ndarray, edits: int, kind: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The window of the item's length over a copy with ``edits`` edits of one kind at random words, from the first of the item's first words on; and the item from that word on."""
    hit, new = np.isin(np.arange(len(h)), rng.choice(len(h), edits, replace=False)), rng.integers(1, 1 << 62, len(h))
    out: list[int] = []
    for word, edit, other in zip(h.tolist(), hit.tolist(), new.tolist(), strict=True):
        out += {"replaced": [other], "added": [word, other], "lost": []}[kind] if edit else [word]
    firsts = h[: edits + 1].tolist()
    while out and out[0] not in firsts:
        del out[0]
    at = firsts.index(out[0]) if out else 0
    out += rng.integers(1, 1 << 62, max(0, len(h) - len(out))).tolist()
    return np.array(out[: len(h)], np.uint64), from_word(h, at)


def repetitions_for(items: list[np.ndarray], percent: int, bits: int, target_recall: float, pairs: int = 64, trials: int = 128, most: int = 256) -> tuple[int, int]:
    """(repetitions, bits) by which edits at the full rate of items of one length reach the target on average, for each kind of edit; each pair counts with its own chance.

    A chance counts as 1 / (2 trials + 2) at least. Where ``most`` repetitions are too few, keys are of a bit less.
    """
    rng, edits = np.random.default_rng(11), allowed_edits(len(items[0]), percent)
    plain = [items[i % len(items)] for i in range(pairs)]
    copies = [[np.stack(x) for x in zip(*(_simulated_edits(h, edits, kind, rng) for h in plain), strict=True)] for kind in KINDS] if edits else []
    for b in range(bits, 0, -1):
        probe, need = CgkSampler(trials, bits, seed=13), 1
        for window, own in copies:
            chance = ((probe.keys(own, bits=b) == probe.keys(window, bits=b)).sum(1) + 0.5) / (trials + 1)
            recall = 1 - ((1 - chance)[:, None] ** np.arange(1, 4 * most + 1)).mean(0)
            need = max(need, 1 + int((recall < target_recall).sum()))
        if need <= most or b == 1:
            return min(need, 4 * most), b
    raise ValueError("bits must be 1 or more")


def without_runs(hit: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Hits without the inside of runs of one word pair, which an item holds ``most`` times at most.

    A window that begins or ends inside a run, or holds all of it, still counts at least as many as an item could share with it there.
    """
    same = places[1:] == places[:-1]
    if not same.any():
        return hit
    borders = np.flatnonzero(np.r_[True, ~same])
    length = np.diff(np.r_[borders, len(places)])
    index = np.arange(len(places)) - np.repeat(borders, length)
    return hit * ((index < most) | (np.repeat(length, length) - index <= most))


def first_places(words: np.ndarray, n: int) -> np.ndarray:
    """Place in the bitmap of a word among the first of an item of ``n`` words."""
    with np.errstate(over="ignore"):
        x = (words ^ np.uint64(n)) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)).astype(np.int64)


def bits_at(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1


@dataclass(frozen=True)
class Filters:
    """What a task must know of the items: tables of fixed size, and for each length the groups that have items of it."""

    lengths: tuple[tuple[int, int], ...]  # (n, bit mask of groups), rising
    percent: int
    pairs: np.ndarray
    masks: np.ndarray
    firsts: np.ndarray
    pair_most: int

    def need(self, n: int) -> int:
        return max(0, n - 1 - 2 * allowed_edits(n, self.percent))

    @cached_property
    def density(self) -> tuple[int, int]:
        """(w, t): any stretch that passes for some length has ``t`` hits among some ``w`` pairs in a row, or in a text of fewer."""
        w = max(1, min(n + allowed_edits(n, self.percent) for n, _ in self.lengths) - 1)
        return w, min(-(-self.need(n) // -(-max(1, n + allowed_edits(n, self.percent) - 1) // w)) for n, _ in self.lengths)


def find_windows(h: np.ndarray, f: Filters, block: int = 4096) -> list[tuple[int, int, np.ndarray]]:
    """(item length, start in the window, window with its margins) of each place of a text that passes the filters."""
    if not len(h):
        return []
    pairs = word_pairs(h)
    hit = without_runs(bits_at(f.pairs, pairs), pairs, f.pair_most)
    sums = np.r_[0, np.cumsum(hit, dtype=np.int64)]
    w, t = f.density
    w = min(w, len(pairs))
    dense = np.flatnonzero(sums[w:] - sums[: len(sums) - w] >= t)
    if not len(dense):
        return []
    reach = max(n + allowed_edits(n, f.percent) for n, _ in f.lengths)
    begin, end = max(0, int(dense[0]) - reach), min(len(h), int(dense[-1]) + w + 1)
    out, seen = [], set()
    for first in range(begin, end, block):
        by_group = None
        for n, groups in f.lengths:
            edits = allowed_edits(n, f.percent)
            starts = np.arange(first, min(first + block, end, len(h) - (n - edits) + 1))
            if not len(starts):
                continue
            need = f.need(n)
            ends = np.minimum(starts + n + edits, len(h)) - 1
            ok = sums[ends] - sums[starts] >= need
            starts, ends = starts[ok], ends[ok]
            ok = bits_at(f.firsts, first_places(h[starts], n)) == 1
            starts, ends = starts[ok], ends[ok]
            if not len(starts):
                continue
            if need:
                if by_group is None:
                    part = slice(first, first + block + reach)
                    bits = (f.masks[pairs[part] >> MASK_SHIFT][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
                    by_group = np.zeros((len(bits) + 1, 64), np.int32)
                    np.cumsum(bits.astype(np.int32) * hit[part].astype(np.int32)[:, None], axis=0, out=by_group[1:])
                own = [g for g in range(64) if groups >> g & 1]
                ok = (by_group[np.ix_(ends - first, own)] - by_group[np.ix_(starts - first, own)] >= need).any(1)
                starts = starts[ok]
            for p in starts.tolist():
                low = max(0, p - edits)
                window = h[low : p + n + edits]
                if (n, p - low, window.tobytes()) not in seen:
                    seen.add((n, p - low, window.tobytes()))
                    out.append((n, p - low, window))
    return out


def item_filters(items: DataFrame, percent: int) -> Filters:
    """Built in tasks; what comes back is at most 256 parts of the tables and a row for each item length."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, item in zip(b["n"], b["item"], strict=True):
                h, group = np.frombuffer(item, np.uint64), np.uint64(1) << np.uint64(group_of(item))
                met, first = np.unique(word_pairs(h)), np.unique(first_places(h[: allowed_edits(n, percent) + 1], n))
                yield pd.DataFrame({"kind": np.repeat([0, 1], [len(met), len(first)]).astype("i4"), "place": np.r_[met, first], "mask": np.full(len(met) + len(first), group).view("i8")})

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        at, size = g["place"].to_numpy("i8") & (PART_BITS - 1), PART_BITS
        bits, masks = np.zeros(size // 8, np.uint8), np.zeros(size >> MASK_SHIFT, np.uint64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        np.bitwise_or.at(masks, at >> MASK_SHIFT, g["mask"].to_numpy("i8").view(np.uint64))
        return pd.DataFrame({"kind": g["kind"].iloc[:1].to_numpy(), "part": g["place"].iloc[:1].to_numpy() // PART_BITS, "bits": [bits.tobytes()], "masks": [masks.tobytes()]})

    told = items.mapInPandas(places, "kind int, place long, mask long").groupBy("kind", "place").agg(F.bit_or("mask").alias("mask"))
    parts = told.groupBy("kind", F.floor(F.col("place") / PART_BITS)).applyInPandas(pack, "kind int, part long, bits binary, masks binary").collect()
    tables = [np.zeros(BITMAP_BITS // 8, np.uint8), np.zeros(BITMAP_BITS // 8, np.uint8)]
    masks = np.zeros(BITMAP_BITS >> MASK_SHIFT, np.uint64)
    for r in parts:
        at = r["part"] * PART_BITS
        tables[r["kind"]][at // 8 : (at + PART_BITS) // 8] = np.frombuffer(r["bits"], np.uint8)
        if r["kind"] == 0:
            masks[at >> MASK_SHIFT : (at + PART_BITS) >> MASK_SHIFT] = np.frombuffer(r["masks"], np.uint64)

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": b["n"], "mask": np.array([1 << group_of(x) for x in b["item"]], np.uint64).view("i8")})

    of_length = items.mapInPandas(groups, "n int, mask long").groupBy("n").agg(F.bit_or("mask").alias("mask")).orderBy("n").collect()  # a row for each item length
    most = items.agg(F.max("pair_most")).first()[0]
    return Filters(tuple((r["n"], r["mask"] & (1 << 64) - 1) for r in of_length), percent, tables[0], masks, tables[1], most)


def group_of(item: bytes) -> int:
    return xxhash.xxh64_intdigest(item) & 63


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    edit_percent: int = 20,
    min_words: int = 1,
    bits: int = 2,
    target_recall: float = 0.98,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """(doc_id, item_id, edits, item_words): every pair of a text and an item it holds within the allowed edits, least edits found."""
    spark = docs.sparkSession

    def hash_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [word_hashes(words_of_text(t)) for t in b["text"]]
            keep = [len(x) >= min_words for x in h]
            kept = [x for x in h if len(x) >= min_words]
            yield pd.DataFrame({"item_id": b["item_id"][keep], "n": [len(x) for x in kept], "item": [x.tobytes() for x in kept], "pair_most": [int(np.unique(word_pairs(x), return_counts=True)[1].max(initial=0)) for x in kept]})

    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").alias("text"))
    items = write_and_reread(items.mapInPandas(hash_items, "item_id long, n int, item binary, pair_most int"), "leak-items")
    if items.isEmpty():
        return spark.createDataFrame([], "doc_id long, item_id long, edits int, item_words int")
    told = spark.sparkContext.broadcast(item_filters(items, edit_percent))
    drawn = items.withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy(F.xxhash64("item_id"), "item"))).where("k <= 16")

    def measure(g: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(x, np.uint64) for x in g.sort_values("k")["item"]]
        r, b = repetitions_for(held, edit_percent, bits, target_recall)
        return pd.DataFrame({"n": [len(held[0])], "r": [r], "b": [b]})

    repetitions = {x["n"]: (x["r"], x["b"]) for x in drawn.groupBy("n").applyInPandas(measure, "n int, r int, b int").collect()}  # three numbers an item length
    sampler = CgkSampler(max(r for r, _ in repetitions.values()), bits)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = told.value
        for b in slices(batches):
            rows = [(doc_id, n, at, xxhash.xxh3_128_digest(w.tobytes() + bytes(str(at), "ascii")), w.tobytes()) for doc_id, text in zip(b["doc_id"], b["text"], strict=True) for n, at, w in find_windows(word_hashes(words_of_text(text)), filters)]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "at", "content", "window"]).astype({"doc_id": "Int64", "n": "int32", "at": "int32"})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = write_and_reread(texts.mapInPandas(windows, "doc_id long, n int, at int, content binary, window binary"), "leak-windows")
    contents = found.groupBy("n", "content").agg(F.first("window").alias("window"), F.first("at").alias("at"))

    def keyed(column: str, ident: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for n, part in b.groupby("n"):
                    words = [np.frombuffer(x, np.uint64)[at : at + n] for x, at in zip(part[column], part["at"], strict=True)]
                    w = np.stack([np.pad(x, (0, n - len(x))) for x in words])  # items from a later word on are shorter
                    keys = sampler.keys(w, *repetitions[n]).view("i8")
                    yield pd.DataFrame({"n": np.int32(n), ident: np.repeat(part[ident].to_numpy(), keys.shape[1]), "key": keys.ravel()})

        return run

    window_keys = contents.mapInPandas(keyed("window", "content"), "n int, content binary, key long")
    item_keys = items.dropDuplicates(["n", "item"]).withColumn("content", F.md5("item").cast("binary")).withColumn("at", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") * edit_percent / 100).cast("int")))).mapInPandas(keyed("item", "content"), "n int, content binary, key long").withColumnRenamed("content", "same")
    met = window_keys.join(item_keys, ["n", "key"]).select("n", "content", "same").distinct()
    unique_items = items.withColumn("same", F.md5("item").cast("binary"))
    asked = met.join(contents, ["n", "content"]).join(unique_items.select("n", "same", "item").distinct(), ["n", "same"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            most = [allowed_edits(n, edit_percent) for n in b["n"]]
            d = [held_edits(np.frombuffer(i, np.uint64).tolist(), np.frombuffer(w, np.uint64).tolist()) for w, i in zip(b["window"], b["item"], strict=True)]
            out = b[["n", "content", "same"]].assign(edits=np.array(d, "i4"))
            yield out[out["edits"] <= most]

    close = asked.mapInPandas(verify, "n int, content binary, same binary, edits int")
    hits = found.select("doc_id", "n", "content").distinct().join(close, ["n", "content"]).groupBy("doc_id", "n", "same").agg(F.min("edits").alias("edits"))
    return hits.join(unique_items.select("item_id", "n", "same"), ["n", "same"]).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.min("n").cast("int").alias("item_words"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """The documents that hold no benchmark item; the ids of the others go out by broadcast if they are few, else join by shuffle."""
    leaked = write_and_reread(find_leaks(docs, benchmark, **options).select("doc_id").where("doc_id IS NOT NULL").distinct(), "leaked")
    return docs.join(F.broadcast(leaked) if leaked.count() <= broadcast_rows else leaked, "doc_id", "left_anti").select(*docs.columns)
