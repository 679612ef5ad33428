"""Hard negatives, collocations and MinHash groups against plain versions, and on odd rows."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scholion.llm import minhash, negatives, phrases, queries, words


def plain_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(found[k : k + 4]) for k in range(max(1, len(found) - 3))) if found else frozenset()


def plain_groups(sets):
    root = {k: k for k in sets}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((of(a), of(b)))
            root[high] = low
    return {k: of(k) for k in sets}


def test_minhash_groups(spark, sf, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.queries()["op13_minhash"](spark, sf).collect()}
    sets = {k: plain_set(v) for k, v in docs.items()}
    root = plain_groups(sets)
    assert got == {k: (len(sets[k]), root[k], root[k] == k) for k in docs}


def chained(seed, n, size, edits):
    """Texts that each differ a little from the one before, so that links make long chains; and a common first line."""
    rng = random.Random(seed)
    base, out = [f"w{rng.randrange(10**6)}" for _ in range(size)], []
    for _ in range(n):
        for _ in range(edits):
            base[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(base))
    return out


def test_chains_short_texts_and_small_blocks(spark, monkeypatch):
    """Links that stars alone don't decide, in blocks of a few members."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "STAR", 2)
    monkeypatch.setattr(minhash, "BROADCAST_NODES", 1)
    texts = chained(1, 40, 60, 2) + chained(2, 25, 300, 6) + chained(3, 30, 16, 1) + chained(4, 20, 45, 1)
    texts += ["a b c d", "a b c d e", "A B c d", "a b", "a b", "a  b ", "", None, "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.minhash_groups(frame).collect()}
    assert got == plain_groups({k: plain_set(v) for k, v in enumerate(texts)})


def test_minhash_edges(spark, odd, none):
    rows = minhash.minhash_groups(odd).collect()
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows)
    assert got == sorted([("1", 9, "1"), ("1", 9, "1"), ("5", 9, "1"), ("2", 0, "2"), ("3", 0, "3"), ("None", 6, "None"), ("None", 0, "None"), ("4", 5, "4"), ("6", 0, "6"), ("2", 3, "2"), ("7", 1, "7")])
    assert minhash.minhash_groups(none).count() == 0


def test_densified_bins_agree_as_sets_do():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    for size in (41, 60, 300, 2000):
        agree, share = [], []
        for _ in range(60):
            both = rng.choice(pool, size * 10 // 9, replace=False)
            a, b = np.sort(both[: size]), np.sort(both[-size:])
            minima = minhash.signatures([a, b])
            agree.append((minima[0] == minima[1]).mean())
            share.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree) - np.mean(share)) < 0.05
        assert minhash.signatures([a])[0].tolist() == minhash.signatures([a, b])[0].tolist()


def plain_negatives(rows, every=100, low=80):
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, label, vec in rows:
        if i % every:
            continue
        scored = sorted((-score(vec, v), j, m) for j, m, v in rows if j != i)
        good = [(s, j) for s, j, m in scored if m == label][:5]
        for p, j in good:
            inside = [(s, k) for s, k, m in scored if m != label and low * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("page", [negatives.PAGE, 24])
def test_hard_negatives(spark, monkeypatch, page):
    """Clusters, ties and one place that many rows share, in one page and in many."""
    monkeypatch.setattr(negatives, "PAGE", page)
    monkeypatch.setattr(negatives, "LEAF", 8)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 5))
    vectors = [centres[k % 6] + 0.3 * rng.normal(size=5) for k in range(300)] + [centres[0]] * 60 + [np.zeros(5)] * 5
    rows = [(k, int(rng.integers(0, 4)), [float(x) for x in np.round(v, 1)]) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame([(k, x, m) for k, m, x in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, negatives.hard_negatives(negatives.usable(frame), every=20).collect()))
    assert got == plain_negatives([(k, m, [math.floor(256 * x) for x in v]) for k, m, v in rows], every=20)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.4], 2), (None, [1.0, 0.4], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 1.0], None), (8, [1.3], 2), (9, [], 1), (100, [-1.0, 0.0], 3)]
    frame = spark.createDataFrame([(*r, "?", "?") for r in rows], "vec_id long, embedding array<double>, label int, key string, score string")
    got = [tuple(r) for r in negatives.hard_negatives(negatives.usable(frame)).orderBy("positive_id", "rank").collect()]
    assert got == [(0, 1, 1, 2, 98304, 91648), (0, 1, 2, None, 98304, 91648), (0, 1, 3, 8, 98304, 84992)]
    assert negatives.hard_negatives(negatives.usable(frame.limit(0))).count() == 0
    huge = spark.createDataFrame([(0, [1e7], 1), (1, [1e7], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="2\\^53"):
        negatives.hard_negatives(negatives.usable(huge))


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 64, 10_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        found = phrases.PerfectHash(keys)
        assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
        others = rng.integers(0, 2**64, 5000, dtype=np.uint64)
        assert (found.slots(others[~np.isin(others, keys)]) == -1).all()


def plain_phrases(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            found = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(found)
            for m in range(1, 5):
                for k in range(len(found) - m + 1):
                    counts[lang][tuple(found[k : k + m])] += 1
    out = []
    for lang, f in counts.items():
        often = {x: a for x, a in f.items() if len(x) > 1 and a >= least}
        inner = defaultdict(int)
        for x, a in often.items():
            for m in range(2, len(x)):
                for k in range(len(x) - m + 1):
                    inner[x[k : k + m]] = max(inner[x[k : k + m]], a)
        scored = []
        for x, a in often.items():
            cuts = [(2_000_000 * a // (f[x[:k]] + f[x[k:]]), k, f[x[:k]], f[x[k:]]) for k in range(1, len(x))]
            score, _, left, right = min(cuts)
            if not (x in inner and 100 * inner[x] >= 80 * a):
                scored.append((-score, -a, " ".join(x).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def test_phrases_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "TEXT_CHUNK", 40)
    monkeypatch.setattr(phrases, "SEGMENTS", 3)
    rng = random.Random(6)
    rows = [(rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choices(["New", "york", "CITY", "hall.", "é", "a,", "b;\tc", "\n"], k=rng.randint(0, 30)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("en", " \n "), ("de", "x " * 500), ("en", rows[0][1])] * 2
    frame = spark.createDataFrame([(k, *r, "?", "?") for k, r in enumerate(rows)], "doc_id int, lang string, text string, key string, count string")
    got = sorted(map(tuple, phrases.mine_phrases(frame, least=4, top=7).collect()))
    assert got == plain_phrases(rows, 4, 7) and len(got) > 20
    assert phrases.mine_phrases(frame.limit(0)).count() == 0 and phrases.mine_phrases(frame, least=10**6).count() == 0


def test_runs_of_words_have_keys_of_their_own():
    hashes = words.WordHashes().of([b"a", b"b", b"a", b"b", b"c", b"a"])
    for n in range(1, 5):
        keys = words.runs(hashes, n)
        texts = ["ababca"[k : k + n] for k in range(7 - n)]
        assert len(set(keys.tolist())) == len(set(texts)) and [keys.tolist().index(x) for x in keys.tolist()] == [texts.index(x) for x in texts]
    assert len(words.runs(hashes[:2], 3)) == 0


def test_calibrated_scores_rise_and_don_t_depend_on_order():
    from scholion.llm.toxicity import _calibration

    rng = np.random.default_rng(8)
    for _ in range(50):
        shares = rng.integers(0, 6, 40) / 5
        labels, weights = rng.integers(0, 2, 40).astype(float), rng.choice([1.0, 7.0], 40)
        x, y = _calibration(shares, labels, weights)
        assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and ((y > 0) & (y < 1)).all()
        mixed = rng.permutation(40)
        assert all(np.allclose(a, b) for a, b in zip((x, y), _calibration(shares[mixed], labels[mixed], weights[mixed]), strict=True))
    tied = _calibration(np.zeros(55), np.array([0.0] * 50 + [1.0] * 5), np.ones(55))
    assert len(tied[0]) == 1 and 0.09 < tied[1][0] < 0.11
    assert (np.diff(_calibration(np.array([0.0, 1.0]), np.array([1.0, 0.0]), np.ones(2))[1]) > 0).all()
