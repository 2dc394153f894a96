"""Quality rules: an ordered list of threshold conjunctions learned from labelled statistics.

Statistics of each text are plain Spark SQL expressions. Sequential covering learns rules for the
low-quality class: a rule grows by the threshold condition with the best information gain, is pruned on
rows that it did not grow on, and is kept only if it stays precise there; the rows it covers leave the
training set and the next rule is learned. The list comes out as one Spark ``CASE WHEN`` expression.

Everything on the row path is DataFrame work. The driver sees only counts per (statistic, bin): a few hundred
numbers for any size of input.

Defined results: a null text has no words, so all its counts are 0 and it fails the base rule; an empty
text likewise. Repeated rows are judged one by one. An empty or one-sided label table gives an empty rule list,
so the verdict is the base rule alone. Extra columns of the input are ignored, also if named like a statistic.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphbatch.llm.common import SPACE_CLASS, bounded_sample, cut, words_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_lines_per_100_words", "repeat_share", "distinct_share", "upper_share")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: the id, the base counts and the learned list's features; with ``carry`` also the whole row as ``_row``.

    ``n_repeat_words`` counts the positions inside a 3-word window that occurs twice or more. Windows are compared
    by 64-bit hash within one text; only texts that do repeat one go through the position sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*(F.col(c) for c in docs.columns)).alias("_row")] if carry else []
    kept = ["_row"] if carry else []
    step = docs.select(
        *row,
        F.col(id_col).alias("doc_id"),
        words_of(F.col(text_col)).alias("_w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("_lines"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).alias("_upper"),
    )
    n = F.size("_w")
    step = step.select(
        *kept,
        "doc_id",
        "n_symbols",
        "_upper",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        F.when(n >= 3, F.transform(F.slice(F.arrays_zip(F.col("_w"), F.slice("_w", 2, n), F.slice("_w", 3, n)), 1, n - 2), lambda x: F.xxhash64(x))).alias("_h"),
    )
    m = F.size("_h")
    step = step.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < m, F.sort_array(F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(0), m - 1).alias("i")))))
    same = lambda x, k: (x["h"] == F.get(F.col("_s"), k - 1)["h"]) | (x["h"] == F.get(F.col("_s"), k + 1)["h"])
    step = step.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    per_word = lambda x: F.when(F.col("n_words") > 0, x / F.col("n_words")).otherwise(F.lit(0.0))
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(
        *kept,
        "doc_id",
        *COUNTS,
        per_word(F.col("word_chars")).alias("mean_word_chars"),
        per_word(F.col("n_symbols")).alias("symbols_per_word"),
        per_word(F.lit(100.0) * F.col("n_dup_lines")).alias("dup_lines_per_100_words"),
        per_word(F.col("n_repeat_words")).alias("repeat_share"),
        per_word(F.col("_distinct")).alias("distinct_share"),
        F.when(F.col("word_chars") > 0, F.col("_upper") / F.col("word_chars")).otherwise(F.lit(0.0)).alias("upper_share"),
    )


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules for the low-quality class; a text that no rule covers is kept."""

    rules: tuple[Rule, ...] = field(default=())

    def rule_index(self) -> Column:
        """1-based number of the first rule that covers the row, 0 if none does."""
        out = F.lit(0)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(), F.lit(k)).otherwise(out)
        return out

    def keeps(self) -> Column:
        return self.rule_index() == 0


def _bins(sample: DataFrame, features: Sequence[str], n_bins: int) -> dict[str, list[float]]:
    """Quantiles of all rows and of the low-quality ones: a statistic that is 0 for most rows still gets cuts."""
    levels = [k / n_bins for k in range(1, n_bins)]
    low = lambda f: F.when(F.col("low") == 1, F.col(f))
    row = sample.agg(*(F.percentile_approx(f, levels, 10_000).alias(f) for f in features), *(F.percentile_approx(low(f), levels, 10_000).alias(f"low_{f}") for f in features)).first()
    seen = {f: sorted({float(x) for x in (row[f] or []) + (row[f"low_{f}"] or [])}) for f in features}
    return {f: sorted({*v, *((a + b) / 2 for a, b in zip(v, v[1:], strict=False))}) for f, v in seen.items()}


def _bin_of(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: value > c)) if cuts else F.lit(0)


def _best_condition(rows: DataFrame, features: Sequence[str], cuts: dict[str, list[float]], used: set, min_cover: int) -> Condition | None:
    """The condition with the largest FOIL gain over ``rows``; one aggregation, one row per (feature, bin) comes back."""
    one = [F.struct(F.lit(k).alias("f"), F.col(f"bin_{f}").alias("b")) for k, f in enumerate(features)]
    counts = rows.select("low", F.explode(F.array(*one)).alias("x")).groupBy("x.f", "x.b").agg(F.sum("low").alias("p"), F.count("*").alias("n")).collect()
    per: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        per.setdefault(r["f"], {})[r["b"]] = (int(r["p"]), int(r["n"]))
    best, best_gain, best_counts = None, 1e-9, None
    for k, by_bin in sorted(per.items()):
        total_p, total_n = sum(p for p, _ in by_bin.values()), sum(n for _, n in by_bin.values())
        if not total_p or total_p == total_n:
            return None
        below_p = below_n = 0
        for b, threshold in enumerate(cuts[features[k]]):
            p, n = by_bin.get(b, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for above, cp, cn in ((False, below_p, below_n), (True, total_p - below_p, total_n - below_n)):
                cond = Condition(features[k], above, threshold)
                if cp < min_cover or cond in used or cn == total_n:
                    continue
                gain = cp * (math.log2(cp / cn) - math.log2(total_p / total_n))
                if gain > best_gain:
                    best, best_gain, best_counts = [cond], gain, (cp, cn)
                elif best and best_counts == (cp, cn) and (best[0].feature, best[0].above) == (cond.feature, cond.above):
                    best.append(cond)
    if best is None:
        return None
    # Cuts that split the rows alike leave a gap between the classes; the rule takes its middle.
    return Condition(best[0].feature, best[0].above, (best[0].threshold + best[-1].threshold) / 2)


def learn_decision_list(
    stats: DataFrame,
    labels: DataFrame,
    features: Sequence[str] = FEATURES,
    sample_limit: int = 20_000,
    n_bins: int = 32,
    max_rules: int = 10,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_cover: int = 5,
) -> DecisionList:
    """Sequential covering. ``stats`` must hold the features of the labelled rows, ``labels`` (doc_id, quality).

    It is fitted on at most ``sample_limit`` labelled rows, chosen by hash of the id: the bound of the fit, not of
    what the list is later applied to. Two thirds of them grow the rules, one third prunes them.
    """
    wanted = bounded_sample(labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")), F.col("doc_id"), sample_limit)
    # The label sample holds at most sample_limit rows of two numbers: its size is bounded, so it may be broadcast.
    sample = cut(stats.join(F.broadcast(wanted), "doc_id").select("doc_id", *features, (F.col("quality") == 0).cast("int").alias("low")))
    cuts = _bins(sample, features, n_bins)
    binned = [_bin_of(F.col(f), cuts[f]).alias(f"bin_{f}") for f in features]
    rows = cut(sample.select("*", *binned, (F.pmod(F.xxhash64(F.lit("prune"), F.col("doc_id")), F.lit(3)) == 0).alias("prune")).coalesce(4))
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        inside = left.where(~F.col("prune"))
        while len(conditions) < max_conditions:
            cond = _best_condition(inside, features, cuts, set(conditions), min_cover)
            if cond is None:
                break
            conditions.append(cond)
            inside = inside.where(cond.column())
        if not conditions:
            break
        aggs = []
        for k in range(1, len(conditions) + 1):
            hit = Rule(tuple(conditions[:k]), 0.0, 0).column()
            aggs += [F.sum(F.when(hit, F.col("low")).otherwise(0)).alias(f"p{k}"), F.sum(hit.cast("int")).alias(f"n{k}")]
        got = left.where("prune").agg(*aggs).first()
        scored = [((got[f"p{k}"] or 0) + 1e-9, got[f"n{k}"] or 0, k) for k in range(1, len(conditions) + 1)]
        # Prune to the prefix that covers most at the asked precision on rows the rule did not grow on.
        fit = [(n, -k) for p, n, k in scored if n >= min_cover and p / n >= min_precision]
        if not fit:
            break
        n, k = max(fit)
        k = -k
        rule = Rule(tuple(conditions[:k]), scored[k - 1][0] / n, n)
        rules.append(rule)
        left = left.where(~rule.column())
    return DecisionList(tuple(rules))


def _learn(docs: DataFrame, labels: DataFrame, **options) -> DecisionList:
    wanted = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    labelled = docs.join(F.broadcast(bounded_sample(wanted, F.col("doc_id"), options.get("sample_limit", 20_000))), "doc_id", "left_semi")
    return learn_decision_list(text_statistics(labelled), labels, **options)


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, base_failed, rule (0: none), kept; one row per input row."""
    learned = _learn(docs, labels, **options)
    out = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", learned.rule_index())
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass the base rule and the learned list, all columns as they were; no join, no shuffle of texts."""
    learned = _learn(docs, labels, **options)
    # The row number keeps the filter above the statistics: pushed below, each of its terms would repeat their whole computation.
    judged = text_statistics(docs, carry=True).withColumn("_at", F.monotonically_increasing_id())
    return judged.where(~base_failed() & learned.keeps() & (F.col("_at") >= 0)).select("_row.*")
