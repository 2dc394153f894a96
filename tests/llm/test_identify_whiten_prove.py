"""Language models, whitening and the Merkle manifest against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphbatch.llm import language_id as L
from graphbatch.llm import merkle as K
from graphbatch.llm import whitening as W

SYLLABLES = {"aa": ["ba", "na", "lo", "ti", "ré"], "bb": ["zu", "kra", "shi", "ßo", "na"], "cc": ["ща", "но", "ли", "ту", "ре"]}


def sentence(lang: str, r: random.Random, words: int) -> str:
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(words))


def read(text: str) -> str:
    out = "".join(c.lower() if c.isalpha() else " " for c in text)
    return "".join(c for k, c in enumerate(out) if c != " " or k == 0 or out[k - 1] != " ")


class PlainModel:
    """Interpolated Kneser-Ney by the textbook, from the runs of all texts."""

    def __init__(self, texts: list[str], n: int, known: int):
        self.n, self.known, self.c = n, known, {n: Counter()}
        for t in texts:
            x = "\2" * (n - 1) + read(t)
            self.c[n].update(x[k : k + n] for k in range(len(x) - n + 1))
        for k in range(n - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.total, self.types = {}, defaultdict(int), defaultdict(int)
        for k, c in self.c.items():
            once, twice = (sum(v == m for v in c.values()) for m in (1, 2))
            self.d[k] = min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.75))
            for g, v in c.items():
                self.total[k, g[:-1]] += v
                self.types[k, g[:-1]] += 1

    def p(self, g: str) -> float:
        k = len(g)
        if k == 0:
            return 1 / (self.known + 1)
        shorter = self.p(g[1:])
        if not (total := self.total.get((k, g[:-1]))):
            return shorter
        return max(self.c[k].get(g, 0) - self.d[k], 0) / total + self.d[k] * self.types[k, g[:-1]] / total * shorter

    def entropy(self, text: str) -> float:
        x = "\2" * (self.n - 1) + read(text)
        return -sum(math.log(self.p(x[k : k + self.n])) for k in range(len(x) - self.n + 1)) / (len(x) - self.n + 1)


def frame(spark, rows, shape):
    return spark.createDataFrame(rows, shape)


@pytest.mark.parametrize("shard_rows", [4_000_000, 40])
def test_entropies_are_those_of_the_textbook(spark, shard_rows, monkeypatch):
    r = random.Random(3)
    rows = [(sentence(lang, r, 12), lang) for lang in ("aa", "bb", "cc") for _ in range(6)] + [(None, "aa"), ("bana", None), ("", "bb")]
    from graphbatch.llm.common import scratch_path, write_and_reread

    counts = write_and_reread(L.count_runs(frame(spark, rows, "text string, lang string").repartition(4), 4), "t")
    langs, shards = L.write_arrays(L.kneser_ney(counts, 4), uri := scratch_path(spark, "lm"), shard_rows)
    assert langs == ["aa", "bb", "cc"] and (shards > 1) == (shard_rows == 40)
    texts = [t for t, lang in rows if t and lang]
    known = len({c for t in texts for c in read(t)})
    plain = [PlainModel([t for t, lang in rows if t is not None and lang == x], 4, known) for x in langs]
    asked = [sentence("aa", r, 5), sentence("cc", r, 9), "Bana, 12 QQ!!  ßo\n\nxyz", "b", "9 ba"]
    got = L.cross_entropies(frame(spark, list(enumerate(asked)), "k long, text string"), L.LanguageModels(uri, tuple(langs), shards, 4), ["k"]).orderBy("k").collect()
    for x, text in zip(got, asked, strict=True):
        assert x["length"] == len(read(text))
        assert np.allclose(x["entropies"], [m.entropy(text) for m in plain])


def test_pieces_of_long_texts_join_without_a_seam(monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice("aÉb 1\n,。中") for _ in range(5000))

    def grams():
        letters = np.zeros(2, bool)
        return Counter(map(tuple, np.concatenate([w.points[w.starts[:, None] + np.arange(5)] for w in L.windows_of([text, "x" + text], 5, letters)]).tolist())), letters.tolist()

    whole = grams()
    monkeypatch.setattr(L, "PIECE", 7)
    assert grams() == whole
    x = "\2\2\2\2" + read(text)
    assert sum(whole[0].values()) == len(read(text)) + len(read("x" + text)) and tuple(map(ord, x[100:105])) in whole[0]


def test_predictions_of_held_out_texts(spark):
    r = random.Random(5)
    rows = []
    for k in range(240):
        lang = ("aa", "bb", "cc")[k % 3]
        rows.append((k, sentence(lang, r, r.randrange(3, 40)), lang, "x", "y", 1.0))
    rows += [(900, None, "aa", "", "", 0.0), (901, "", None, "", "", 0.0), (902, "12 34 .,", "bb", "", "", 0.0), (None, "bana lo", "aa", "", "", 0.0), (5, rows[5][1], rows[5][2], "", "", 0.0)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, length string, entropies string, score double")
    got = L.predicted_languages(docs).collect()
    assert len(got) == len(rows) and sum(x["doc_id"] == 5 for x in got) == 2
    by = {x["doc_id"]: x for x in got}
    for k, text, lang, *_ in rows:
        x = by[k]
        assert x["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= x["score"] <= 1
        if text and any(c.isalpha() for c in text):
            assert x["lang_pred"] == lang or len(text) < 12
        else:
            assert (x["lang_pred"], x["score"], x["rejected"]) == ("und", 0.0, True)


def test_foreign_texts_are_rejected(spark):
    r = random.Random(8)
    rows = [(k, sentence(("aa", "cc")[k % 2], r, 30), ("aa", "cc")[k % 2]) for k in range(1600)]
    models = L.train(frame(spark, rows, "doc_id long, text string, lang string"), F.col("doc_id"))
    assert set(models.limits) == {"aa", "cc"}
    asked = [(0, sentence("aa", r, 30)), (1, sentence("cc", r, 30)), (2, "qwx " * 40), (3, "zzgf hjkl " * 30)]
    got = {x["k"]: x["rejected"] for x in L.identify(frame(spark, asked, "k long, text string"), models, ["k"]).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True}


def test_no_labels_and_no_rows(spark):
    shape = "doc_id long, text string, lang string"
    assert L.predicted_languages(frame(spark, [], shape)).collect() == []
    got = L.predicted_languages(frame(spark, [(1, "bana", None)], shape)).collect()
    assert [(x["lang_pred"], x["score"]) for x in got] == [("und", 0.0)]


# ---- whitening


def plain_whitening(vectors: np.ndarray):
    x = np.floor(vectors * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    d = x - s / n
    v = d.T @ d / n
    e, q = np.linalg.eigh(v)
    return x, n, s, d, e[::-1], q[:, ::-1], np.trace(v)


def test_whitening_equals_the_direct_one(spark):
    r = np.random.default_rng(2)
    base = (r.normal(size=(60, 6)) * [3, 2, 1.5, 1, 0.7, 0.4]).astype(np.float32)
    vectors = np.concatenate([base, np.repeat(base[:1], 40, 0), base[3:5]])
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    bad = [(900, None, ""), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (902, [float("nan")] * 6, ""), (903, [float("inf")] + [0.0] * 5, ""), (904, [], ""), (905, [1.0, 2.0], "")]
    table = frame(spark, rows + bad + [(None, vectors[0].tolist(), "")], "vec_id long, embedding array<float>, x string").repartition(5)
    x, n, s, d, e, q, trace = plain_whitening(np.concatenate([vectors, vectors[:1]]).astype(np.float64))
    for most in (32, 4):
        got = W.whiten(table, ["vec_id"], most=most).toPandas()
        assert len(got) == n * min(most, 6) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
        assert got["vec_id"].isna().sum() == min(most, 6)
        for k in range(1, min(most, 6) + 1):
            part = got[(got["component"] == k) & got["vec_id"].notna()].sort_values("vec_id")
            want = d[:-1] @ q[:, k - 1] / np.sqrt(e[k - 1])
            assert np.allclose(part["whitened"], want, atol=1e-8) or np.allclose(part["whitened"], -want, atol=1e-8)
            assert np.allclose(part["explained"], e[k - 1] / trace)
            assert part["deviation"].tolist() == ((n * x[:-1] - s) ** 2).sum(1).tolist()
    one = W.whiten(table, ["vec_id"], weights="one").toPandas()
    assert set(one["n"]) == {60} and one["identity_error"].max() < 1e-9


def test_whitening_without_variance_or_rows(spark):
    shape = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        out = W.whiten(frame(spark, rows, shape), ["vec_id"])
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = W.whiten(frame(spark, [(1, [0.0, 7.0]), (2, [1.0, 7.0])], shape), ["vec_id"]).collect()  # one entry never varies
    assert {x["component"] for x in flat} == {1} and all(abs(abs(x["whitened"]) - 1) < 1e-12 and x["explained"] == 1 for x in flat)


def test_deviations_beyond_64_bits():
    model = W.Whitening(3, np.array([0]), np.array([0]), np.zeros((0, 1)), np.zeros(0), 0.0)
    assert model.deviations(np.array([[1 << 40], [5]])) == [None, 225]


# ---- manifest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes: list[str]) -> tuple[str, list[list[list[str]]]]:
    """(root, per leaf and level the digests left and right of its node)."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            sides[k].append([run[: p % 8], run[p % 8 + 1 :]])
        nodes, at = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], sides


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = h(*map(framed, (i, source, lang, n, text)))
        low = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = h(*map(framed, (i, source, lang, n, low))) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else leaf
        groups[lang].append(((i is not None, i or 0), leaf, tampered, i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: (sorted(groups[g]), *climb([x[1] for x in sorted(groups[g])])) for g in order}
    root, tops = climb([subs[g][1] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        members, sub, sides = subs[g]
        for (_, leaf, tampered, i), own in zip(members, sides, strict=True):
            path, folded = own + top, tampered
            for left, right in path:
                folded = h(*left, folded, *right)
            out.append((i, leaf, sub, root, h(*(d for left, right in path for d in left + right)), folded, folded == root))
    return sorted(out, key=repr)


def manifest_of(spark, rows):
    docs = frame(spark, [(*x, "clash", "clash", 7) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, g string, i int").repartition(5)
    return sorted((tuple(x) for x in K.document_manifest(docs).collect()), key=repr)


@pytest.mark.parametrize("shape", [[70, 9, 1], [8], [1], [64, 65, 2, 1, 1, 1, 1, 1, 3], [513]])
def test_manifest_equals_the_plain_one(spark, shape):
    r = random.Random(sum(shape))
    langs = [None, "de", "", "é", "Z", "a", "aa", "+", "zz"]
    rows = [(r.randrange(10**6), r.choice(["Text %d", "text %d", None, "Ünï %d"]), langs[k], r.choice(["web", None]), r.choice([None, 3])) for k, n in enumerate(shape) for _ in range(n)]
    rows = [(i, t if t is None else t.replace("%d", str(i)), *rest) for i, t, *rest in rows]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_of_ties_and_nothing(spark):
    same = [(7, "A", "de", "s", 1)] * 20 + [(None, "B", None, None, None)] * 3 + [(7, "C", "de", "s", 1), (8, "", "de", "", 0)]
    assert manifest_of(spark, same) == plain_manifest(same)
    assert manifest_of(spark, []) == []


def test_proofs_of_a_few_leaves(spark):
    rows = frame(spark, [(g, k, h(str(g), str(k))) for g in ("a", "b", "c") for k in range(100)], "grp string, k long, d string")
    m = K.build(rows, "grp", "k", "d")
    asked = m.groups.leaves.where("(grp = 'a' AND k IN (0, 1, 99)) OR (grp = 'c' AND k = 50)")
    got = K.prove(m, asked, ["grp", "k", "d"]).withColumn("up", K.fold(F.col("leaf"), F.col("path"))).collect()
    assert {(x["grp"], x["k"]) for x in got} == {("a", 0), ("a", 1), ("a", 99), ("c", 50)}
    assert all(x["leaf"] == x["d"] and x["up"] == m.root and len(x["path"]) == 4 for x in got)
