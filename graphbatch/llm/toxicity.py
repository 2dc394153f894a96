"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs and digit substitutions to plain letters and every other non-letter to a space, so ``1D10T`` and a
word with Cyrillic look-alikes match like the plain word. The lexicon is learned from labelled texts: word beginnings and whole
words that many more toxic than clean texts hold, weighted by log odds. Exception phrases are lexicon words with a neighbour that
mark clean texts; a match inside one does not count. A text's matched weight, in total and per word, goes through a logistic curve.

Labels, language, source and id are no inputs of a score. Training reads at most ``sample_limit`` labelled texts of each class, chosen by hash of the id;
scoring reads every whole text. The driver holds the lexicon (what ``min_texts`` of the sample share) and the sample's two features a text.

Defined results: a null text counts as empty; a text without matches, also an empty one, gets the curve's value at 0. Repeated
rows score alike. With no labels of one class the lexicon is empty and every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import bisect
import itertools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphbatch.llm.common import cut

#: Characters read as the Latin letter they look like.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
MIN_BEGIN, MAX_BEGIN = 3, 12


class _Folding(dict):
    """Translation table filled as characters are met."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        known = HOMOGLYPHS.get(ch) or SUBSTITUTES.get(ch)
        if not known:
            wide = unicodedata.normalize("NFKC", ch).lower() if code > 0x2000 else ch
            known = wide if wide.isalpha() else "" if unicodedata.category(ch) in ("Cf", "Mn") else " "
        self[code] = known
        return known


FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Folded words, each between single or more spaces, with a space at both ends."""
    return f" {(text or '').lower().translate(FOLDING)} "


def word_patterns(word: str) -> list[str]:
    """Beginnings of a word, and the word as a whole with its ending space; all start with a space."""
    return [f" {word[:k]}" for k in range(MIN_BEGIN, min(len(word), MAX_BEGIN) + 1)] + [f" {word} "] * (len(word) >= MIN_BEGIN)


@dataclass(frozen=True)
class ToxicModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (0.0, 0.0, -20.0)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for pattern, weight in self.lexicon.items():
            out.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), 0.0))
        if len(out):
            out.make_automaton()
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        a, b, c = self.coefficients
        return 1 / (1 + np.exp(-np.clip(features @ np.array([a, b]) + c, -30, 30)))


def match_weight(folded: str, automaton: ahocorasick.Automaton, exceptions: frozenset[str]) -> float:
    """Summed weight of the longest pattern at each word, without words inside an exception phrase."""
    if not len(automaton):
        return 0.0
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if exceptions and folded[start : end + 1] in exceptions:
            spared.append((start, end))
        elif size > best.get(start, (0, 0.0))[0]:
            best[start] = (size, weight)
    if spared:  # of the phrases that begin up to a match the one that ends last tells whether the match is inside one
        spared.sort()
        starts, last = [a for a, _ in spared], list(itertools.accumulate((b for _, b in spared), max))
        before = lambda at: bisect.bisect_right(starts, at) - 1
        return sum(w for at, (size, w) in best.items() if (k := before(at)) < 0 or at + size - 2 > last[k])
    return sum(w for _, w in best.values())


def text_features(texts, automaton: ahocorasick.Automaton, exceptions: frozenset[str]) -> np.ndarray:
    """Per text: log of 1 + the matched weight, and the matched weight per 100 words."""
    out = np.zeros((len(texts), 2))
    for k, text in enumerate(texts):
        folded = fold(text)
        weight = match_weight(folded, automaton, exceptions)
        if weight:
            out[k] = math.log1p(weight), 100 * weight / max(20, len(folded.split()))
    return out


def _fit(features: np.ndarray, toxic: np.ndarray, l2: float = 1e-3) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; both slopes are held at 0 or more."""
    scale = np.maximum(features.std(0), 1e-9)
    x = np.column_stack([features / scale, np.ones(len(features))])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = l2 * np.array([1, 1, 0.01]) * len(x)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (toxic - p) - penalty * w)
        w = w + step
        w[:2] = np.maximum(w[:2], 0)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale[0]), float(w[1] / scale[1]), float(w[2])


def train(docs: DataFrame, labels: DataFrame, sample_limit: int = 10_000, min_texts: int = 5, min_log_odds: float = 2.5, exception_texts: int = 5) -> ToxicModel:
    """Learn from ``labels`` (doc_id, toxic); at most ``sample_limit`` texts of each class."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    wanted = known.where("toxic = 1").orderBy(*order).limit(sample_limit).union(known.where("toxic = 0").orderBy(*order).limit(sample_limit))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id"))  # the sample's ids are bounded
    sizes = {r["toxic"]: r["k"] for r in sample.groupBy("toxic").agg(F.count("*").alias("k")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicModel(coefficients=(0.0, 0.0, 20.0 if n_toxic else -20.0))

    def counts(patterns_of):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                seen = {0: Counter(), 1: Counter()}
                for text, toxic in zip(b["text"], b["toxic"], strict=True):
                    seen[int(toxic)].update(patterns_of(fold(text)))
                every = list(seen[0].keys() | seen[1].keys())
                yield pd.DataFrame({"pattern": every, "t": [seen[1][p] for p in every], "c": [seen[0][p] for p in every]})

        return sample.mapInPandas(run, "pattern string, t long, c long").groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))

    odds = F.log(((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("c") + 0.5) / (n_clean + 1)))
    begins = counts(lambda folded: {p for w in set(folded.split()) for p in word_patterns(w)})
    rows = begins.withColumn("w", odds).where((F.col("t") >= min_texts) & (F.col("w") >= min_log_odds)).orderBy(F.desc("w"), "pattern").toPandas()  # patterns of the sample
    lexicon = {r.pattern: (r.w, r.t) for r in rows.itertuples()}
    # Of nested patterns found in nearly the same texts the longest says most about what it matches.
    for p in sorted(lexicon, key=len):
        if any(q in lexicon and lexicon[q][1] >= 0.95 * lexicon[p][1] for q in (x for x in lexicon if len(x) == len(p) + 1 and x.startswith(p))):
            del lexicon[p]
    weights = {p: float(w) for p, (w, _) in lexicon.items()}
    told = sample.sparkSession.sparkContext.broadcast(ToxicModel(weights))

    def phrases(folded: str) -> set[str]:
        words = folded.split()
        hits = [k for k, w in enumerate(words) if any(p in weights for p in word_patterns(w))]
        return {f" {words[a]} {words[a + 1]} " for k in hits for a in (k - 1, k) if 0 <= a < len(words) - 1}

    spared = counts(phrases).where((F.col("c") >= exception_texts) & (F.col("t") * 20 <= F.col("c"))).orderBy(F.desc("c"), "pattern").toPandas()  # phrases of the sample
    exceptions = tuple(spared["pattern"])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ToxicModel(told.value.lexicon, exceptions).automaton()
        for b in batches:
            f = text_features(b["text"], automaton, frozenset(exceptions))
            yield pd.DataFrame({"a": f[:, 0], "b": f[:, 1], "toxic": b["toxic"].astype("i4")})

    fitted = sample.mapInPandas(features, "a double, b double, toxic int").toPandas()  # two numbers a sampled text
    return ToxicModel(weights, exceptions, _fit(fitted[["a", "b"]].to_numpy(), fitted["toxic"].to_numpy()))


def score_texts(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """The input's columns but the text, with ``score`` in [0, 1]."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in (text_col, "score")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = told.value
        automaton, exceptions = m.automaton(), frozenset(m.exceptions)
        for b in batches:
            yield b[[f.name for f in kept]].assign(score=m.score(text_features(b["_text"], automaton, exceptions)))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"
    return docs.select(*(f.name for f in kept), F.col(text_col).alias("_text")).mapInPandas(run, shape)


def held_out(doc_id: Column) -> Column:
    """The third of the ids that learning must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learned from labels whose id is not held out."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), **options)
    scored = score_texts(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
