"""The text operators against brute force on small fixtures, with nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import base64
import collections
import datetime
import hashlib
import itertools
import random
import re
import string
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphbatch.llm import bpe, decontamination, ngram_join, pii, quality_rules, substring_dedup, token_output, toxicity, url_filters, warc
from graphbatch.llm.common import scratch_path
from graphbatch.llm.files import open_fs

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "tu", "ve", "zo") for b in ("ban", "cor", "dil", "fes", "gam", "hut", "jol", "kim", "lap", "mer")]
SHAPE = "doc_id long, text string, n_words int, kept string, seed int, extra string"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def frame(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, -1, "x", 5, "e") for i, t in rows], SHAPE)


def odd_rows() -> list[tuple[int | None, str | None]]:
    r = random.Random(0)
    long_text = prose(r, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long_text), (5, long_text), (6, "one"), (7, "one"), (7, "one"), (None, prose(r, 60)), (8, "naïve é Ünï 日本語 \U0001f600 <|endoftext|> x"), (9, "a\x0bb\x0cc\rd\x1ce\xa0f")]


def some_docs(seed: int, n: int = 60) -> list[tuple[int, str]]:
    r = random.Random(seed)
    out: list[tuple[int, str]] = []
    for i in range(n):
        if out and r.random() < 0.5:
            words = r.choice(out)[1].split(" ")
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            out.append((i, " ".join(words)))
        else:
            out.append((i, prose(r, r.choice([3, 8, 40, 90]))))
    return out


# ---- quality rules


def brute_statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = collections.Counter(tri), set()
    for i, x in enumerate(tri):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    r = random.Random(1)
    rows = odd_rows() + [(100 + i, "\n".join(prose(r, r.randrange(6)) for _ in range(8)) + r.choice(["", " # | <b>", "\nab cd ef ab cd ef ab"])) for i in range(30)]
    got = quality_rules.text_statistics(frame(spark, rows)).select("doc_id", *quality_rules.COUNTS).collect()
    assert sorted(map(repr, (tuple(x) for x in got))) == sorted(repr((i, *brute_statistics(t))) for i, t in rows)


def test_rules_find_planted_low_quality(spark):
    r = random.Random(2)
    bad = {i for i in range(400) if i % 5 == 0}
    rows = [(i, prose(r, 80).replace(" ", "### ") if i in bad else prose(r, 80)) for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i in bad else 1) for i in range(0, 400, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = frame(spark, rows)
    out = {x.doc_id: x for x in quality_rules.quality_verdicts(docs, labels).collect()}
    assert {i for i, x in out.items() if not x.kept} == bad
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(range(400)) - bad


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = {x.doc_id: x.kept for x in quality_rules.quality_verdicts(frame(spark, odd_rows()), none).collect()}
    assert out[1] is False and out[2] is False and out[4] is True
    assert quality_rules.quality_verdicts(frame(spark, []), none).count() == 0


# ---- toxicity


def toxic_rows(seed=3, n=600):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(r, 50).split(" ")
        bad = i % 6 == 0
        if bad:
            words[r.randrange(50)] = r.choice(["grumblefink", "GRUMBLEF1NK", "snortwad", "sn0rtw4d!"])
        elif i % 31 == 0:
            words[10:11] = ["old", "snortwad"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_separates_held_out_texts(spark):
    rows, labels = toxic_rows()
    truth = dict(labels)
    out = toxicity.toxicity_scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    held = [x for x in out if x.held_out]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in out)
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95


def test_toxicity_folding_and_odd_rows(spark):
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt")
    rows, labels = toxic_rows()
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("old snortwad" in p for p in model.exceptions)
    scored = toxicity.score_texts(frame(spark, odd_rows()).select("doc_id", "text"), model).collect()
    assert len(scored) == len(odd_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.predicted for x in toxicity.toxicity_scores(frame(spark, odd_rows()), none).collect()} == {0}
    assert toxicity.toxicity_scores(frame(spark, []), none).count() == 0


def test_match_weight_equals_a_naive_scan():
    r = random.Random(33)
    lexicon = {" bad": 1.0, " badly ": 2.5, " ba": 0.5, " ugl": 3.0, " ugly ": 4.0, " worse ": 1.5}
    exceptions = frozenset([" not bad ", " bad luck ", " old ugly "])
    automaton = toxicity.ToxicModel(lexicon, tuple(exceptions)).automaton()
    for _ in range(500):
        folded = toxicity.fold(" ".join(r.choice(["bad", "badly", "bade", "not", "old", "ugly", "ugliest", "worse", "luck", "x"]) for _ in range(r.randrange(14))))
        spared = [(a, a + len(e)) for e in exceptions for a in range(len(folded)) if folded.startswith(e, a)]
        want = 0.0
        for at in range(len(folded)):
            fit = max((p for p in lexicon if folded.startswith(p, at)), key=len, default=None)
            if fit and not any(a <= at and at + len(fit) <= b + 1 for a, b in spared):
                want += lexicon[fit]
        assert abs(toxicity.match_weight(folded, automaton, exceptions) - want) < 1e-9
    began = time.perf_counter()
    assert toxicity.match_weight(toxicity.fold("old ugly " * 100_000), automaton, exceptions) == 0
    assert time.perf_counter() - began < 10


# ---- n-gram join


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 1024), (5, 80, 8), (2, 60, 5)])
def test_components_equal_brute_force(spark, words, percent, block):
    rows = some_docs(7, 90) + [(200, None), (201, ""), (202, "one"), (203, "one"), (204, "ONE"), (205, " \n")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar_components(frame(spark, rows), words, percent, block=block).collect()}
    assert got == brute_components(rows, words, percent)


def test_links_are_the_same_by_broadcast_and_by_shuffle(spark):
    docs = frame(spark, some_docs(11, 40)).select("doc_id", "text")
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.combinations(range(40), 2)], "a long, b long")
    few, many = ({tuple(x) for x in ngram_join.verified_links(docs, pairs, 4, 85, n, share).collect()} for n, share in ((10_000, 1000), (0, 7)))
    assert few == many and few


def test_trees_lose_no_pair():
    r = np.random.default_rng(1)
    base = r.poisson(2, (60, 128))
    v = np.concatenate([base, np.maximum(0, base + r.integers(-1, 2, base.shape) * (r.random(base.shape) < 0.1)), r.poisson(2, (400, 128))]).astype(np.uint8)
    n, parts = v.sum(1, dtype=np.int64), np.r_[np.arange(60), np.arange(60) + 30, np.full(400, 7)]
    tree = np.sort(r.integers(0, 3, len(v)))
    forest = ngram_join.CountVectorForest(tree, v, n, parts)
    assert len(forest.levels) >= 3
    roots = np.arange(len(forest.levels[-1].tree))
    found = [np.concatenate(x) for x in zip(*forest.descend(len(forest.levels) - 1, roots, roots, 80, chunk=500), strict=True)]
    want = {(a, b) for a, b in itertools.combinations(range(len(v)), 2) if tree[a] == tree[b] and parts[a] != parts[b] and np.minimum(v[a], v[b]).sum(dtype=int) >= ngram_join.needed_overlap(n[a] + n[b], 80)}
    assert set(zip(found[0].tolist(), found[1].tolist(), strict=True)) == want and len(want) >= 20
    assert all(np.minimum(v[a], v[b]).sum(dtype=int) == c for a, b, c in zip(*found, strict=True))


def test_bounds_of_all_levels_hold():
    """Folded counts bound the overlap from above, also where a count takes two bytes."""
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 4000, n).astype(np.uint64)) for n in (1, 20, 70, 150, 400, 900, 2000, 5000)] + [np.arange(0, 300 * 2048, 2048, dtype=np.uint64)]
    levels = ngram_join.level_of(np.array([len(s) for s in sets]))
    packed = np.array([ngram_join.count_vector(s) for s in sets], object)
    assert len(set(levels)) > 3 and levels.max() <= ngram_join.TOP_LEVEL
    for level in sorted(set(levels)):
        at = np.flatnonzero(levels >= level)
        v = ngram_join.unpacked(packed[at], levels[at], int(level))
        assert (v.sum(1, dtype=int) == [len(sets[k]) for k in at]).all()
        for i, j in itertools.combinations(range(len(at)), 2):
            assert np.minimum(v[i], v[j]).sum(dtype=int) >= len(np.intersect1d(sets[at[i]], sets[at[j]]))


@pytest.mark.parametrize(("words", "percent", "block", "seed", "told"), [(3, 70, 6, 5, 1_000_000), (4, 85, 4, 6, 0)])
def test_groups_of_copies_equal_brute_force(spark, words, percent, block, seed, told):
    """Groups around a few texts, some just under the threshold, in lists of many blocks."""
    r = random.Random(seed)
    first = [prose(r, 60).split(" ") for _ in range(3)]
    rows = []
    for i in range(150):
        base = list(r.choice(first))
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            base[r.randrange(60)] = r.choice(WORDS)
        rows.append((i, " ".join(base)))
    rows += [(0, rows[0][1]), (3, rows[90][1])]
    sets = brute_components([*rows[:150]], words, percent)
    got = ngram_join.similar_components(frame(spark, rows[:150]), words, percent, block=block, broadcast_rows=told).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == sets and len({c for _, c in sets.values()}) > 1
    again = ngram_join.similar_components(frame(spark, rows), words, percent, block=block).collect()
    assert len(again) == 152 and {x.component_id for x in again} <= set(range(150))


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = some_docs(8, 60)
    docs = frame(spark, rows + [(None, rows[0][1]), (500, None)])
    kept = ngram_join.keep_one_of_each(docs, words=5, percent=80)
    roots = {r for _, r in brute_components(rows, 5, 80).values()}
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == roots | {None, 500}
    assert ngram_join.similar_components(frame(spark, [])).count() == 0
    repeated = ngram_join.similar_components(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert [x.component_id for x in repeated] == [1, 1, 1]


# ---- PII


def test_pseudonyms_are_valid_linked_and_told_apart(spark):
    text = "card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112; call +1 (743) 555-3824; at 12.34.56.78 not 300.1.1.1; on 2020-02-29 not 2021-02-29; x@y.org 123-45-6789"
    rows = [(1, text), (2, "again 4111-1111-1111-1111 12.34.56.78 X@Y.org"), (3, None), (4, ""), (5, "no digits"), (6, "9" * 5000), (1, text)]
    docs = frame(spark, rows)
    got = pii.pseudonymise(docs, "k", count_col="n").collect()
    out = {x.doc_id: x for x in got}
    assert pii.pseudonymise(docs, "k").columns == docs.columns and len(got) == len(rows)
    assert out[3].text is None and out[4].text == "" and out[5].text == "no digits" and out[6].text == "9" * 5000
    for gone in ("4111 1111 1111 1111", "4111111111111111", "743) 555", "12.34.56.78", "2020-02-29", "x@y.org", "123-45-6789"):
        assert gone not in out[1].text
    for stays in ("4111111111111112", "300.1.1.1", "2021-02-29"):
        assert stays in out[1].text
    card = re.search(r"card ((?:\d{4} ){3}\d{4})", out[1].text)[1].replace(" ", "")
    digits = [int(c) for c in card[::-1]]
    assert sum(digits[::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) % 10
    assert card in out[1].text.replace(" ", "") and card in out[2].text.replace("-", "")
    assert re.search(r"\d+\.\d+\.\d+\.\d+", out[2].text)[0] in out[1].text and re.search(r"\S+@\S+", out[2].text)[0] in out[1].text
    other = pii.pseudonymise(docs, "another").where("doc_id = 2").first().text
    assert other != out[2].text


def test_cards_before_short_numbers_and_undivided_digits_are_found(spark):
    card, secret = "4111 1111 1111 1111", "a1b2c3d4" * 4
    rows = [(1, f"pay {card} 12/27 now"), (2, f"pay {card} 123"), (3, "pay " + "-".join("4111111111111111")), (4, f"token {secret}"), (5, f"pay {card}"), (6, "pay 4111 1111 1111 1112 123")]
    out = {x.doc_id: (x.text, x.n) for x in pii.pseudonymise(frame(spark, rows), "k", count_col="n").collect()}
    new = out[5][0].removeprefix("pay ")
    assert new != card and out[1] == (f"pay {new} 12/27 now", 1) and out[2] == (f"pay {new} 123", 1)
    assert out[3] == ("pay " + "-".join(new.replace(" ", "")), 1)
    assert secret not in out[4][0] and out[4][1] == 1 and out[6] == (rows[5][1], 0)


def brute_pseudonym(key: str, v: str) -> str | None:
    """One finding's pseudonym in plain Python."""

    def network(kind: str, value: int, a: int, b: int) -> int:
        x, y = divmod(value, b)
        for r in range(1, 9):
            other = y if r % 2 else x
            add = int(hashlib.sha256(f"{key}|{kind}|{r}|{other}|{key}".encode()).hexdigest()[:15], 16)
            x, y = ((x + add) % a, y) if r % 2 else (x, (y + add) % b)
        return x * b + y

    def luhn(d: str) -> int:
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))

    def put(value: str, digits: str) -> str:
        left = iter(digits)
        return re.sub("[0-9]", lambda _: next(left), value)

    digits = re.sub("[^0-9]", "", v)
    for kind, pattern in pii.KINDS:
        if not re.fullmatch(pattern, v, re.A):
            continue
        if kind == "email":
            return "u" + hashlib.sha256(f"{key}|email|{v.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
        if kind == "secret" and re.search("[0-9]", v) and re.search("[a-fA-F]", v):
            h = hashlib.sha512(f"{key}|secret|{v.lower()}".encode()).hexdigest()
            return "".join([h, *(hashlib.sha512(f"{key}|{h}|{k}".encode()).hexdigest() for k in range(1, -(-len(v) // 128)))])[: len(v)]
        if kind == "ip" and max(octets := list(map(int, v.split(".")))) <= 255:
            n = network("ip", int.from_bytes(bytes(octets)), 65_536, 65_536)
            return ".".join(map(str, n.to_bytes(4)))
        if kind == "date":
            iso = v[4] == "-"
            y, m, d = map(int, v.split("-") if iso else reversed(re.split("[./]", v)))
            try:
                day = (datetime.date(y, m, d) - datetime.date(1900, 1, 1)).days
            except ValueError:
                continue
            if 1900 <= y <= 2099:
                new = datetime.date(1900, 1, 1) + datetime.timedelta(network("date", day, 17, 4297))
                sep = re.search("[./]", v)
                return new.isoformat() if iso else new.strftime(f"%d{sep[0]}%m{sep[0]}%Y")
        if kind == "ssn" and digits[:3] not in ("000", "666") and v[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000":
            group, serial = divmod(network("ssn", (int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1, 99, 9999), 9999)
            return f"{digits[:3]}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "phone":
            ten = digits[-10:]
            new = f"{network('phone', int(ten[1:3] + ten[4:]), 10_000, 10_000):08d}"
            return put(v, digits[:-10] + ten[0] + new[:2] + ten[3] + new[2:])
        if kind == "card":
            shorter = (re.match(rf"\d(?:[ -]?\d){{{n - 1}}}(?=[ -])", v) for n in range(18, 12, -1))
            for c in [v, *(m[0] for m in shorter if m)]:
                d = re.sub("[^0-9]", "", c)
                if luhn(d) % 10 == 0:
                    n, half = len(d), (len(d) - 2) // 2
                    head = d[0] + f"{network(f'card{n}', int(d[1:-1]), 10 ** (n - 2 - half), 10**half):0{n - 2}d}"
                    return put(c, head + str(-luhn(head + "0") % 10)) + v[len(c) :]
    return None


def test_pseudonyms_equal_brute_force(spark):
    r = random.Random(31)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(n: int) -> str:
        d = digits(n - 1)
        check = -sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10
        sep = r.choice(["", " ", "-"])
        return sep.join(f"{d}{check}"[k : k + 4] for k in range(0, n, 4))

    makers = [
        lambda: card(r.randrange(13, 20)), lambda: card(16) + " 12/27", lambda: digits(r.randrange(1, 25)),
        lambda: r.choice(["", "+1 ", "1-"]) + f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}.{digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: ".".join(str(r.randrange(300)) for _ in range(4)), lambda: f"{r.randrange(1890, 2110)}-{r.randrange(14):02d}-{r.randrange(33):02d}",
        lambda: f"{r.randrange(1, 33)}{r.choice('./')}{r.randrange(1, 14)}.{r.randrange(1890, 2110)}", lambda: f"A.b+{digits(2)}@Mail-{digits(1)}.org", lambda: "a@b", lambda: "x@y..z",
        lambda: "".join(r.choice("0123456789abcdefABCDEF") for _ in range(r.choice([31, 32, 64, 128, 129, 300]))), lambda: r.choice(WORDS), lambda: r.choice(["é", "\n", "--", ".", "_"]),
    ]
    rows = [(i, r.choice(["", " ", " ", "."]).join(r.choice(makers)() + r.choice(["", " ", " ", ", ", "."]) for _ in range(r.randrange(12)))) for i in range(600)]
    out = {x.doc_id: (x.text, x.n) for x in pii.pseudonymise(frame(spark, rows), "k", count_col="n").collect()}
    total = 0
    for i, text in rows:
        done = []
        want = re.sub(pii.ANY, lambda m: done.append(x) or x if (x := brute_pseudonym("k", m[0])) is not None else m[0], text, flags=re.A)  # noqa: B023
        assert out[i] == (want, len(done))
        total += len(done)
    assert total > 500


def test_very_long_runs_of_each_kind(spark):
    r = random.Random(32)
    n = 100_000
    hexadecimal = "".join(r.choice("0123456789abcdef") for _ in range(n))
    runs = ["9" * n, "1 " * n, "1-" * n, "a@b" + ".c" * n, "a" * n, "a@" * n, "1." * n, hexadecimal, "a-" * n + "@b.c", "(1" * n, "4111 1111 1111 1111 " * 2000, "1/1/2000 " * 2000]
    out = {x.doc_id: (x.text, x.n) for x in pii.pseudonymise(frame(spark, list(enumerate(runs))), "k", count_col="n").collect()}
    assert [out[k][1] for k in (3, 7, 8, 10, 11)] == [1, 1, 1, 2000, 2000]
    assert len(out[7][0]) == n and out[7][0][:500] != hexadecimal[:500] and out[4] == (runs[4], 0)


@pytest.mark.parametrize(("a", "b"), [(10, 10), (17, 43), (1, 7), (99, 101)])
def test_feistel_permutes_its_domain(spark, a, b):
    got = [x.v for x in spark.range(a * b).select(pii.feistel("k", "t", F.col("id"), a, b).alias("v")).collect()]
    assert sorted(got) == list(range(a * b))


def test_pii_plan_is_native(spark):
    plan = pii.pseudonymise(frame(spark, []), "k", count_col="n")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert pii.pseudonymise(frame(spark, []), "k").count() == 0


# ---- decontamination


def test_leaks_are_found_and_clean_texts_left(spark):
    r = random.Random(5)
    items = [(i, prose(r, r.randrange(15, 50))) for i in range(20)]
    rows, want = [], set()
    for i in range(120):
        words = prose(r, 150).split(" ")
        if i % 3 == 0:
            item = r.randrange(20)
            leak = items[item][1].split(" ")
            for _ in range(r.choice([0, 0, 1, len(leak) // 10])):
                leak[r.randrange(len(leak))] = "changed"
            words[40:40] = leak
            want.add((i, item))
        rows.append((i, " ".join(words)))
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "two words"), (3, items[3][1])], "item_id long, text string")
    docs = frame(spark, rows + odd_rows()[:4])
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(docs, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    kept = decontamination.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in rows + odd_rows()[:4]} - {d for d, _ in got}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs, none).count() == 0 and decontamination.find_leaks(frame(spark, []), bench).count() == 0


def test_held_edits_equal_the_full_table():
    r = random.Random(16)
    for _ in range(300):
        a, b = [r.randrange(4) for _ in range(r.randrange(1, 12))], [r.randrange(4) for _ in range(r.randrange(16))]
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontamination.held_edits(a, b) == min(row)


def full_rate_leaks(kind: str):
    """Items edited at the full rate of 20 %; around them stand word pairs of other items."""
    r = random.Random(15)
    items = [[f"i{i}w{j}" for j in range(20 + i % 11)] for i in range(20)]
    rows = []
    for i in range(80):
        own, leak = items[i % 20], list(items[i % 20])
        for p in sorted(r.sample(range(1, len(own) - 1), len(own) // 5), reverse=True):
            leak[p : p + 1] = {"delete": [], "insert": [leak[p], "new"], "change": ["new"]}[kind]
        other = items[(i + 7) % 20]
        rows.append((i, " ".join([f"a{i}x{j}" for j in range(40)] + other[-6:] + leak + other[:6] + [f"b{i}x{j}" for j in range(40)])))
    return rows, [(i, " ".join(x)) for i, x in enumerate(items)]


@pytest.mark.parametrize("kind", ["delete", "insert", "change"])
def test_recall_of_each_kind_of_edit(spark, kind):
    """Items of 20, 57, 100 and 200 words, each edited at the full rate by one kind anywhere, against the full table."""
    r, items, rows, sizes = random.Random(31), [], [], (20, 57, 100, 200)
    for k in range(24):
        items.append([f"{r.choice(WORDS)}{r.randrange(40)}" for _ in range(sizes[k % 4])])
    for i in range(240):
        leak = list(items[i % 24])
        for p in sorted(r.sample(range(len(leak)), len(leak) // 5), reverse=True):
            leak[p : p + 1] = {"delete": [], "insert": [leak[p], "new"], "change": ["new"]}[kind]
        rows.append((i, " ".join([*(f"{r.choice(WORDS)}{r.randrange(40)}" for _ in range(30)), *leak, *(r.choice(WORDS) for _ in range(30))])))
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(frame(spark, rows), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()}
    for k in range(4):
        assert sum((i, i % 24) in got for i in range(240) if i % 4 == k) >= 0.95 * 60, sizes[k]


def test_private_values_beside_clashing_columns(spark):
    row = ("a@b.org", ["x"], "kept", 5, 1.5)
    df = spark.createDataFrame([row, (None, None, None, None, None)], "text string, _found array<string>, found string, _new long, row double")
    out = pii.pseudonymise(df, key="k", count_col="n").collect()
    assert out[0][1:5] == row[1:] and out[0]["text"].endswith("@example.invalid") and out[0]["n"] == 1 and tuple(out[1]) == (None, None, None, None, None, 0)
    with pytest.raises(ValueError):
        pii.pseudonymise(df, key="k", count_col="found")


@pytest.mark.parametrize("kind", ["delete", "insert", "change"])
def test_leaks_at_the_full_rate_are_found(spark, kind):
    rows, items = full_rate_leaks(kind)
    got = {(x.doc_id, x.item_id): x.edits for x in decontamination.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= {(i, i % 20) for i, _ in rows} and len(got) >= 0.95 * len(rows)
    assert all(n <= len(items[item][1].split()) // 5 for (_, item), n in got.items())


def test_recall_against_brute_force(spark):
    """Every text against every item by the full table: items of 1 to 60 words, mixed edits up to beyond the full rate, items in a row."""
    r = random.Random(21)
    items = [prose(r, n).split(" ") for n in [1, 2, 3, 4, *(r.randrange(5, 60) for _ in range(40))]]
    items[0], items[2] = ["unheard"], ["never", "said", "before"]
    rows = []
    for i in range(300):
        words = prose(r, r.choice([0, 20, 120])).split()
        for _ in range(r.choice([1, 1, 2])):
            leak = list(r.choice(items))
            for _ in range(r.randrange(len(leak) * 22 // 100 + 1)):
                at = r.randrange(len(leak)) if leak else 0
                leak[at : at + 1] = r.choice([[], [r.choice(WORDS)], [*leak[at : at + 1], r.choice(WORDS)]])
            at = r.randrange(len(words) + 1)
            words[at:at] = leak
        rows.append((i, " ".join(words)))
    number: dict[bytes, int] = {}
    coded = lambda text: [number.setdefault(w, len(number)) for w in text.encode().lower().split()]
    of_item = {k: coded(" ".join(x)) for k, x in enumerate(items)}
    want = {(i, k): d for i, t in rows for k, x in of_item.items() if (d := decontamination.held_edits(x, coded(t))) <= len(x) // 5}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in decontamination.find_leaks(frame(spark, rows), bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 250
    assert all(got[x] >= want[x] for x in got) and sum(got[x] == want[x] for x in got) >= 0.97 * len(got)


def test_a_leak_without_an_id_stays(spark):
    item = prose(random.Random(3), 30)
    docs = frame(spark, [(None, item), (1, item), (2, "clean"), (None, "clean")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(repr(x.doc_id) for x in decontamination.drop_leaks(docs, bench).collect()) == ["2", "None", "None"]


def test_edit_distance_equals_the_full_table():
    r = random.Random(6)
    for _ in range(200):
        a, b = [r.randrange(4) for _ in range(r.randrange(9))], [r.randrange(4) for _ in range(r.randrange(9))]
        t = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            t = [i, *itertools.accumulate(range(1, len(b) + 1), lambda left, j, t=t, x=x: min(t[j] + 1, left + 1, t[j - 1] + (x != b[j - 1])), initial=i)][1:]
        most = r.randrange(6)
        assert decontamination.edit_distance(a, b, most) == min(t[-1], most + 1)


# ---- substring dedup


def test_repeated_passages_are_found(spark):
    r = random.Random(9)
    passage = prose(r, 70).split(" ")
    rows = []
    for i in range(40):
        words = prose(r, 120).split(" ")
        if i % 4 == 0:
            own = list(passage)
            if i % 8 == 4:
                own[30] = "changed"
            words[20:20] = own
        rows.append((i, " ".join(words)))
    got = substring_dedup.repeated_passages(frame(spark, rows + odd_rows()[:4] + [(6, "one")])).where("doc_id < 100").collect()
    found = {x.doc_id: x for x in got if x.doc_id not in (4, 5)} | {x.doc_id: x for x in got if x.doc_id in (4,) and x.start_word < 200}
    for i in range(4, 40, 4):
        x = found[i]
        assert x.start_word <= 20 and x.end_word >= 90 and x.n_words <= 80 and x.other_doc_id < i
    assert not {i for i in found if i % 4 and i != 5}
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def covered(rows, start, end, doc_id):
    """Share of the words start..end of a text that lie in reported passages."""
    words = {w for x in rows if x.doc_id == doc_id for w in range(x.start_word, x.end_word)}
    return len(words & set(range(start, end))) / (end - start)


def unlike(name: str, n: int) -> str:
    """Words that occur nowhere else."""
    return " ".join(f"{name}{i}" for i in range(n))


def test_passages_around_unlike_text_are_found(spark):
    header, footer = unlike("h", 80), unlike("f", 70)
    long_text = unlike("w", 1000).split(" ")
    changed = long_text[:400] + unlike("new", 90).split(" ") + long_text[490:]
    rows = [(1, f"{header} {unlike('a', 300)} {footer}"), (2, f"{header} {unlike('b', 280)} {footer}"), (3, " ".join(long_text)), (4, " ".join(changed))]
    rows += [(5, f"{unlike('p', 60)} {unlike('c', 55)} {unlike('q', 60)}"), (6, f"{unlike('p', 60)} {unlike('d', 55)} {unlike('q', 60)}")]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert {x.doc_id for x in got} == {2, 4, 6} and all(x.identity == 1 for x in got)
    for doc_id, start, end, here in [(2, 0, 80, True), (2, 80, 360, False), (2, 360, 430, True), (4, 0, 400, True), (4, 400, 490, False), (4, 490, 1000, True), (6, 0, 60, True), (6, 115, 175, True)]:
        assert covered(got, start, end, doc_id) == here


def test_passages_whose_phrases_have_other_holders_are_found(spark):
    passage = unlike("w", 75).split(" ")
    rows = [(i, f"{unlike(f'a{i}x', 20)} {' '.join(passage[i : i + 7])} {unlike(f'b{i}x', 20)}") for i in range(0, 69)]
    rows += [(i, f"{unlike(f'a{i}x', 100)} {' '.join(passage)} {unlike(f'b{i}x', 100)}") for i in (100, 101)]
    got = substring_dedup.repeated_passages(frame(spark, rows)).where("doc_id = 101").collect()
    assert covered(got, 100, 175, 101) == 1 and {x.other_doc_id for x in got} == {100}


def test_every_copy_in_a_text_is_found(spark):
    passage = unlike("w", 70)
    words = passage.split(" ")
    early = " x ".join(" ".join(words[i : i + 5]) for i in range(0, 66))
    rows = [(1, f"{unlike('a', 50)} {passage} {unlike('b', 50)}"), (2, f"{unlike('c', 30)} {passage} {unlike('d', 40)} {passage} {unlike('e', 30)}"), (3, f"{early} {unlike('f', 30)} {passage}")]
    again = unlike("v", 80)
    rows += [(4, f"{again} {unlike('g', 40)} {again} {unlike('i', 40)} {again}"), (5, " ".join(["m", *unlike("n", 9).split(" ")] * 40))]
    rows += [(6, rows[-1][1])]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    n = len(rows[2][1].split(" "))
    for doc_id, start, end in [(2, 30, 100), (2, 140, 210), (3, n - 70, n), (4, 120, 200), (4, 240, 320), (5, 10, 400), (6, 0, 400)]:
        assert covered(got, start, end, doc_id) == 1, (doc_id, start, end)
    for doc_id, start, end in [(1, 0, 170), (2, 100, 140), (4, 0, 120), (4, 200, 240), (5, 0, 10)]:
        assert covered(got, start, end, doc_id) == 0, (doc_id, start, end)


def test_passages_against_brute_force(spark):
    """Verbatim runs of 50 words by a scan of all windows, and stretches of 50 to 500 words moved with words replaced, inserted and left out."""
    r = random.Random(51)
    new = lambda n: [f"{r.choice(WORDS)}{r.choice(WORDS)}" for _ in range(n)]
    texts: list[list[str]] = []
    planted: dict[int, set[int]] = {}
    for i in range(80):
        words = new(r.randrange(60, 700))
        planted[i] = set()
        for _ in range(r.randrange(3) if i > 10 else 0):
            source = texts[r.randrange(i)]
            n = min(len(source), r.randrange(60, 500))
            start = r.randrange(len(source) - n + 1)
            piece = source[start : start + n]
            for _ in range(r.choice([0, n // 40, n // 15])):
                at = r.randrange(len(piece))
                piece[at : at + 1] = r.choice([new(1), [], [piece[at], *new(1)]])
            at = r.choice([0, len(words)])
            words[at:at] = piece
            planted[i] = {p + len(piece) if at == 0 else p for p in planted[i]} | set(range(at, at + len(piece)))
        texts.append(words)
    reported = {i: set() for i in range(80)}
    for x in substring_dedup.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect():
        reported[x.doc_id] |= set(range(x.start_word, x.end_word))
    seen: set[tuple] = set()
    verbatim: dict[int, set[int]] = {}
    for i, t in enumerate(texts):
        runs = [tuple(t[p : p + 50]) for p in range(len(t) - 49)]
        verbatim[i] = {p + k for p, w in enumerate(runs) if w in seen for k in range(50)}
        seen.update(runs)
    share = lambda a, b: sum(len(a[i] & b[i]) for i in a) / sum(map(len, a.values()))
    assert sum(map(len, verbatim.values())) > 2000 and share(verbatim, reported) > 0.99
    assert share(planted, reported) > 0.95 and share(reported, planted) > 0.97


def edited(words: list[str], every: int, name: str) -> list[str]:
    """Every ``every``-th word replaced by one that occurs nowhere else."""
    return [f"{name}{i}" if i % every == every - 1 else w for i, w in enumerate(words)]


def seeds_of(text: str) -> dict[int, int]:
    """Place of each seed of a text."""
    hashes = substring_dedup.windows(substring_dedup.word_hashes(text.encode().split()), 5)
    return {int(hashes[p]): int(p) for p in substring_dedup.minimizers(hashes, 12)}


def around(run: list[str], name: str, text: str) -> list[str]:
    """Texts that hold the run between unlike words, so many that each seed of ``text`` in the run is a seed of one of them."""
    wanted, texts = {s for s, p in seeds_of(text).items() if text.split(" ")[p : p + 5] in [run[i : i + 5] for i in range(len(run) - 4)]}, []
    for k in itertools.count():
        if not wanted:
            return texts
        words = f"{unlike(f'{name}a{k}x', 30)} {' '.join(run)} {unlike(f'{name}b{k}x', 30)}"
        if chosen := wanted & set(seeds_of(words)):
            wanted -= chosen
            texts.append(words)


def test_a_partner_behind_other_holders_of_every_seed_is_found(spark):
    source = unlike("w", 200).split(" ")
    runs = [source[i : i + 11] for i in range(0, 180, 12)]
    copy = f"{unlike('u', 30)} {' '.join(edited(source, 12, 'new'))} {unlike('v', 30)}"
    early, late = ([t for i, run in enumerate(runs) for t in around(run, f"{name}{i}y", copy)] for name in "el")
    rows = [*enumerate(early), (1000, f"{unlike('s', 40)} {' '.join(source)} {unlike('t', 40)}"), *enumerate(late, 2000)]
    rows += [(5000, copy), (5001, copy), (5002, copy)]
    got = substring_dedup.repeated_passages(frame(spark, rows)).where("doc_id >= 5000").collect()
    assert covered(got, 60, 200, 5000) == 1 and {x.other_doc_id for x in got if x.doc_id == 5000} == {1000} and covered(got, 0, 29, 5000) == 0
    assert sorted((x.doc_id, x.start_word, x.end_word, x.other_doc_id, x.identity) for x in got if x.doc_id > 5000) == [(5001, 0, 260, 5000, 1.0), (5002, 0, 260, 5000, 1.0)]


def test_a_place_behind_other_occurrences_of_every_seed_is_found(spark):
    source = unlike("w", 200).split(" ")
    copy = f"{unlike('u', 30)} {' '.join(edited(source, 12, 'new'))} {unlike('v', 30)}"
    alone = [t for i in range(180, -1, -12) for t in around(source[i : i + 11], f"e{i}y", copy)]
    holder = " ".join([*alone * 3, " ".join(source), *alone])
    got = substring_dedup.repeated_passages(frame(spark, [(1, holder), (2, copy), (10, f"{holder} {copy}")])).collect()
    n, end = len(" ".join(alone * 3).split(" ")), len(f"{holder} {copy}".split(" "))
    assert covered(got, 60, 200, 2) == 1 and all(n <= x.other_start_word < n + 200 for x in got if x.doc_id == 2)
    assert covered(got, end - 260, end, 10) == 1


def test_words_between_passages_of_other_holders_are_found(spark):
    left, right, middle = unlike("l", 60), unlike("r", 60), unlike("w", 60).split(" ")
    rows = [(i, f"{unlike(f'a{i}x', 40)} {side} {unlike(f'b{i}x', 40)}") for i, side in [(1, left), (2, right), (4, left), (5, right)]]
    rows += [(3, f"{left} {' '.join(middle)} {right}"), (6, f"{left} {' '.join(edited(middle, 5, 'new'))} {right}")]
    got = substring_dedup.repeated_passages(frame(spark, rows)).where("doc_id = 6").collect()
    assert covered(got, 0, 180, 6) == 1


def places_of(spark, texts):
    """Seeds and places of texts as the tables of ``pairs_in_doubt``, each text one region."""
    asked = [(s, d, 0, x) for d, text in enumerate(texts) for x, s in text]
    holders = []
    for d, text in enumerate(texts):
        for seed in {s for _, s in text}:
            at = [x for x, s in text if s == seed]
            holders.append((seed, d, at[0], np.array(at[1:], "i4").tobytes() if at[1:] else None))
    return spark.createDataFrame(asked, "seed long, doc_id long, region int, x int"), spark.createDataFrame(holders, "seed long, other long, pos int, more binary")


def test_every_pair_with_a_chain_meets(spark):
    r = random.Random(52)
    texts = []
    for _ in range(40):
        at = list(itertools.accumulate(r.choice([1, 2, 5, 12, 40, 90]) for _ in range(r.randrange(1, 9))))
        texts.append([(x, r.choice([1, 2, 3, r.randrange(4, 40)])) for x in at])
    wanted = set()
    for d, text in enumerate(texts):
        for other in range(d + 1):
            points = sorted((x, y) for x, s in text for y, z in texts[other] if s == z and (other < d or y < x))
            if points and any(c[1] - c[0] >= 11 for c in substring_dedup.chains(*np.array(points).T, 12, 0.2)):
                wanted.add((d, other))
    assert 100 < len(wanted) < 800 and any(d == other for d, other in wanted)
    asked, holders = places_of(spark, texts)
    for few in (0, 12, 1000):
        got = {(x.doc_id, x.other) for x in substring_dedup.pairs_in_doubt(asked, holders, 60.0, 11, few).collect()}
        assert wanted <= got, few


def test_a_common_short_line_makes_no_pairs(spark):
    asked, holders = places_of(spark, [[(50, 1), (57, 2), (80, 1000 + d // 2), (95, 2000 + d // 2)] for d in range(300)])
    got = {(x.doc_id, x.other) for x in substring_dedup.pairs_in_doubt(asked, holders, 60.0, 11, 50).collect()}
    assert got == {(d, d - 1) for d in range(1, 300, 2)}


def test_chains_equal_the_quadratic_version():
    r = random.Random(10)
    for _ in range(50):
        pts = sorted({(r.randrange(60), r.randrange(60)) for _ in range(25)})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        best = [12.0] * len(pts)
        for i, (a, b) in enumerate(pts):
            for j in range(i):
                if pts[j][0] < a and pts[j][1] < b:
                    best[i] = max(best[i], 12 + best[j] - 0.2 * (a - pts[j][0] + b - pts[j][1]))
        assert abs(substring_dedup.chains(x, y, 12, 0.2)[0][4] - max(best)) < 1e-9


def test_dropped_passages_leave_the_rest(spark):
    docs = frame(spark, [(1, "a b  c d\ne f"), (2, None)])
    spans = spark.createDataFrame([(1, 1, 3)], "doc_id long, start_word int, end_word int")
    out = {x.doc_id: x.text for x in substring_dedup.drop_passages(docs, spans).collect()}
    assert out == {1: "a  d\ne f", 2: None}


# ---- BPE and token output


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.mark.parametrize("size", [1_000_000, 100])
def test_ids_equal_the_library(spark, size):
    rows = odd_rows() + [(100 + i, t) for i, t in some_docs(4, 20)] + [(200, "It's we'll  I'D\n\n x 12ab "), (201, "<|endoftext|><|endoftext|> a")]
    t = library()
    want = sorted((repr(i), t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in rows)
    encoded = bpe.encode_texts(frame(spark, rows), slice_words=size, bucket_chars=size)
    got = sorted((repr(x.doc_id), np.frombuffer(x.ids, "<u4").tolist(), x.n_tokens) for x in encoded.collect())
    assert [(i, ids) for i, ids, _ in got] == [(i, ids) for i, ids, _ in want] and all(len(ids) == n for _, ids, n in got)
    back = sorted((repr(x.doc_id), x.text) for x in bpe.decode_ids(encoded, slice_ids=size).collect())
    assert back == sorted((i, x) for i, _, x in want)
    digests = sorted((repr(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.encode_texts(frame(spark, rows), slice_words=size, bucket_chars=size, digests_only=True).collect())
    assert digests == sorted((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for i, ids, x in want)


def test_bpe_plan_joins_by_slice_and_by_piece(spark):
    plan = bpe.encode_texts(frame(spark, odd_rows()), digests_only=True)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "BroadcastHashJoin" in plan
    assert not re.search(r"Exchange hashpartitioning\(slice", plan)  # the slices are bucketed


def test_bpe_of_no_rows_and_other_tokenizers(spark):
    assert bpe.encode_texts(frame(spark, [])).count() == 0
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.WordCoder(public_tokenizers.path("word_bpe_49k.json"))


def test_token_files_round_trip(spark):
    rows = [x for x in odd_rows() if x != (7, "one")] + [(7, "one"), *((100 + i, t) for i, t in some_docs(4, 30))]
    t, uri = library(), scratch_path(spark, "test-tokens")
    manifest = token_output.write_token_files(frame(spark, rows), uri, partitions=4)
    got = sorted(token_output.read_token_files(manifest).collect(), key=lambda x: x.start)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for x, (i, text) in zip(got, order, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        raw = np.array(ids, "<u4").tobytes()
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32, x.ids) == (i, start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    file = max(manifest.collect(), key=lambda x: x.n_docs).file
    doc_id, ids = token_output.read_at(file, 1)
    assert (doc_id, ids.tolist()) in [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows]
    none = token_output.write_token_files(frame(spark, []), scratch_path(spark, "test-tokens"))
    assert token_output.read_token_files(none).count() == 0


def test_damaged_records_are_refused():
    import io

    record = token_output.pack_record(5, np.array([1, 2, 3], "<u4"), 2)
    assert token_output.read_record(io.BytesIO(record))[1].tolist() == [1, 2, 3]
    for k in (3, 9, 15, len(record) - 2):
        with pytest.raises(ValueError):
            token_output.read_record(io.BytesIO(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :]))


# ---- WARC


def test_archives_round_trip(spark):
    r = random.Random(12)
    pages = [(i, f"http://h{i}.org/é%20?\n", r.choice(["", None, "same", prose(r, 200)])) for i in range(60)] + [(None, None, "same"), (70, None, "x" * 2_000_000)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, sha1 string, refers_to int")
    manifest = warc.write_archives(warc.record_roles(df.repartition(3)), scratch_path(spark, "test-warc"), archive_bytes=40_000)
    got = {x.page_id: x for x in warc.read_archives(manifest, with_payload=True).collect()}
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    assert len(got) == len(pages) and manifest.count() > 1
    for i, url, html in pages:
        x, payload = got[i], (html or "").encode()
        assert (x.url, x.payload_bytes, x.payload_digest) == (url, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        lead = first[html or ""]
        assert (x.record_type, x.refers_to) == (("response", None) if lead == i else ("revisit", lead))
        if lead == i:
            assert bytes(x.payload) == payload
    empty = warc.write_archives(warc.record_roles(df.limit(0)), scratch_path(spark, "test-warc"))
    assert warc.read_archives(empty).count() == 0


def test_record_ids_are_unique(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (2, "a"), (3, "c"), (4, "c")]
    df = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.record_roles(df), scratch_path(spark, "test-warc"))
    heads = [h for x in manifest.collect() for h, _ in warc.iterate_records(open_fs(x.file)[0].open_input_stream(open_fs(x.file)[1], compression=None))]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(heads) == len(rows) and len(set(ids)) == len(ids)
    told = {h["X-Page"]: h["WARC-Record-ID"] for h in heads if h.get("X-Page") in ("2", "3", "4")}
    four = next(h for h in heads if h.get("X-Page") == "4")
    assert four["WARC-Refers-To"] == told["3"]
    two = next(h for h in heads if h.get("X-Page") == "2")
    assert two["X-Refers-To-Page"] == "1" and "WARC-Refers-To" not in two  # page 1 is two responses


def test_small_payloads_may_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    roles = {x.page_id: x.refers_to for x in warc.record_roles(df, min_bytes=3).collect()}
    assert roles == {1: None, 2: None}


# ---- URL filters


def test_rules_judge_like_a_scan(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", "/de/", "allow"), ("a.com", "/de/", "block"), (None, "/", "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/en/12?q#f", "http://notexample.org/es/", "https://x.example.org/es/1", "http://com/de/", "http://www.com/de", "http://a.com/de/x", "http://b.a.com/fr/#", "http://ÀB.com/fr/", "x://a//b", "http://h/" + "p" * 50_000, "http://" + "a." * 100_000 + "com/de/"]
    df = spark.createDataFrame([(i, u, "clash", "z") for i, u in enumerate(urls + urls)], "page_id long, url string, host string, rule string")
    out = url_filters.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == 2 * len(urls)
    for x in out:
        url = (urls + urls)[x.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.sub(r"[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[3:] if fits else (None, "allow")
        assert (x.host, x.path, x.rule, x.verdict) == (host, path, *want)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {x.verdict for x in url_filters.filter_urls(df, none).collect()} == {"allow"}
    assert url_filters.filter_urls(df.limit(0), none).count() == 0


# ---- pipeline


def test_each_pipeline_stage_equals_plain_python(spark, tmp_path):
    """Every stage on what its predecessor kept, against the plain versions above."""
    import corpus_pipeline

    r = random.Random(41)
    items = [prose(r, r.randrange(20, 40)) for _ in range(8)]
    low = {i for i in range(160) if i % 3 == 1}
    rows: list[tuple[int | None, str | None]] = []
    for i in range(160):
        if i % 5 == 4:
            words = rows[r.randrange(i)][1].split(" ")
            words[r.randrange(len(words))] = r.choice(WORDS)
        else:
            words = prose(r, r.choice([20, 70, 90])).split(" ")
        if i in low:
            words = [w + "#|" for w in words]
        if i % 7 == 2:
            words[5:5] = r.choice(items).split(" ")
        if i % 6 == 2:
            words[3:3] = ["mail", "ann@corp.example", "or", "4111 1111 1111 1111", "on", "2021-03-04"]
        rows.append((i, " ".join(words)))
    rows += [(160, None), (161, ""), (162, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i not in low), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    def quality(kept):
        rules = quality_rules._learn(docs, labels).rules
        assert rules

        def good(text):
            n, chars, symbols, lines, repeats = brute_statistics(text)
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            of = {"n_words": n, "mean_word_chars": chars / max(1, n), "symbols_per_word": symbols / max(1, n), "dup_lines_per_100_words": 100 * lines / max(1, n), "repeat_share": repeats / max(1, n)}
            of |= {"distinct_share": len(set(words)) / max(1, n), "upper_share": sum(c in string.ascii_uppercase for c in text or "") / max(1, chars)}
            low = any(all(of[c.feature] > c.threshold if c.above else of[c.feature] <= c.threshold for c in rule.conditions) for rule in rules)
            return not (n < 50 or 100 * repeats > 50 * n) and not low

        return [x for x in kept if good(x[1])]

    def near_duplicates(kept):
        first = brute_components(kept, 5, 80)
        return [x for x in kept if first[x[0]][1] == x[0]]

    def decontaminate(kept):
        number: dict[bytes, int] = {}
        coded = lambda text: [number.setdefault(w, len(number)) for w in text.encode().lower().split()]
        of_item = [coded(x) for x in items]
        return [x for x in kept if not any(decontamination.held_edits(i, coded(x[1])) <= len(i) // 5 for i in of_item)]

    def pseudonyms(kept):
        key = spark.conf.get("spark.corpus.pseudonymKey")
        return [(i, re.sub(pii.ANY, lambda m: brute_pseudonym(key, m[0]) or m[0], t, flags=re.A)) for i, t in kept]

    def encode(kept):
        t = library()
        return [(i, t.encode(x, add_special_tokens=False).ids) for i, x in kept]

    kept, plain = docs, list(rows)
    for (name, stage), version in zip(corpus_pipeline.STAGES, (quality, near_duplicates, decontaminate, pseudonyms, encode), strict=True):
        kept, before = stage(spark, kept, sf), len(plain)
        plain = version(plain)
        got = [(x.doc_id, np.frombuffer(x.ids, "<u4").tolist()) for x in kept.collect()] if name == "BPE encoding" else [(x.doc_id, x.text) for x in kept.collect()]
        assert sorted(got) == sorted(plain), name
        assert len(plain) < before or version in (pseudonyms, encode)
    assert plain and sorted((x.doc_id, np.frombuffer(x.ids, "<u4").tolist()) for x in corpus_pipeline.run(spark, sf).collect()) == sorted(plain)


def test_pairs_of_a_group_of_near_copies_are_not_made(spark, monkeypatch):
    """Each round gives at most a row a point and list; the group has several components, and many of its pairs miss the threshold closely."""
    from graphbatch.llm.common import write_and_reread
    from graphbatch.llm.shingles import shingle_set

    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(3000)}" for _ in range(60)], []
    for doc_id in range(300):
        words = list(base)
        words[rng.randrange(60)] = f"x{doc_id}"
        rows.append((doc_id, " ".join(words)))
    made, pairs, verified = [], ngram_join._pairs, ngram_join.verified_links

    def counted_pairs(points, percent, what):
        points = write_and_reread(points, "points-in")
        out = write_and_reread(pairs(points, percent, what), "pairs-out")
        made.append((what, points.count(), out.count()))
        return out

    def counted_links(docs, asked, *args):
        made.append(("verify", made[-1][1], asked.count()))
        return verified(docs, asked, *args)

    monkeypatch.setattr(ngram_join, "_pairs", counted_pairs)
    monkeypatch.setattr(ngram_join, "verified_links", counted_links)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_components(docs, words=4, percent=85).collect()}
    sets, label = [set(shingle_set(t, 4).tolist()) for _, t in rows], list(range(300))
    for a in range(300):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert found == dict(enumerate(label)) and len(set(label)) > 10
    assert len(made) >= 5 and all(out <= given for _, given, out in made), made


def test_overlaps_of_sets_by_bits_and_one_by_one():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200))).astype("u8") for _ in range(12)]
    i, j = np.array(list(itertools.permutations(range(12), 2))).T
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    for options in ({}, {"most_bytes": 0}, {"chunk_bytes": 8}):
        assert ngram_join.overlaps(sets, i, j, **options).tolist() == want
