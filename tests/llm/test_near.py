"""The near-duplicate stage against a comparison of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from netdensity.llm import near, simhash  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS).repartition(3)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """The least index that each text reaches by links of similarity 0.8."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def planted():
    rng = random.Random(7)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, texts = prose(60), []
    for k in range(30):
        base = prose(100)
        texts.append(base)
        for changes in (1, 2, 3, 4):
            copy = list(base)
            for p in rng.sample(range(5, 95), changes):
                copy[p] = "changed"
            texts.append(copy)
    texts += [passage + prose(15) for _ in range(40)] + [passage + prose(4) for _ in range(30)]
    texts += [[*passage, *prose(5), *passage[:30]] for _ in range(20)]
    return [" ".join(t) for t in texts] + ["", " ", "a b", "A  B", "a b c"]


@pytest.mark.parametrize("paired", [16, 2])
def test_components_equal_all_pairs(spark, paired):
    texts = planted()
    df = frame(spark, list(enumerate(texts)))
    root = {r.th: r.root for r in near.near_duplicates(df, paired=paired).collect()}
    of = dict(df.selectExpr("doc_id", "xxhash64(text)").collect())
    label = brute(texts)
    assert len({(root[of[i]], label[i]) for i in of}) == len(set(label)) == len(set(root.values()))


def test_near_stage_equals_all_pairs(spark):
    texts = planted()
    label = brute(texts)
    assert 20 < sum(x < i for i, x in enumerate(label[:150])) < 120  # some copies are within 0.8
    got = corpus_pipeline.near_stage(spark, frame(spark, list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(label))


def test_near_stage_of_nothing(spark):
    assert corpus_pipeline.near_stage(spark, frame(spark, []), "").count() == 0


def test_one_row_of_each_component_whatever_its_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (1, b), (1, b), (2, a), (2, c), (None, c), (None, d), (None, d), (3, b)]
    got = corpus_pipeline.near_stage(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (2, c), (0, d)])


@pytest.mark.parametrize("window", [512, 2])
def test_fingerprint_pairs_are_the_nearest_of_each_list(spark, window):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 60, dtype=np.uint64)
    flip = lambda n: np.uint64(sum(1 << int(p) for p in rng.choice(64, n, replace=False)))
    fps = np.unique(np.concatenate([fps, [f ^ flip(n) for f in fps for n in (1, 4, 5, 9, 14, 22)], [fps[0] ^ np.uint64(v) for v in range(1, 40)]]))
    lists, want = {}, set()
    for f in sorted(fps.view(np.int64).tolist()):
        for s in combinations(range(8), 3):
            lists.setdefault((s, *(f >> 8 * p & 255 for p in s)), []).append(f)
    for (s, *_), members in lists.items():
        for i, f in enumerate(members):
            best = (17, None)
            for g in reversed(members[max(0, i - window) : i]):
                x = (f ^ g) & (2**64 - 1)
                equal = [p for p in range(8) if not x >> 8 * p & 255]
                if tuple(equal[:3]) == s and x.bit_count() < best[0]:
                    best = (x.bit_count(), g)
            want |= {(best[1], f)} - {(None, f)}
    df = spark.createDataFrame([(f,) for f in fps.view(np.int64).tolist()], "fp long").repartition(3)
    assert {tuple(r) for r in simhash.near_pairs(df, 16, 3, window).collect()} == want
    assert len(want) > 150


def test_near_stage_takes_its_links_from_fingerprints(spark, monkeypatch):
    """The index names pairs from the five-word fingerprints; those alike are linked by it, and only the others are left to the prefix lists."""
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        texts += [" ".join(base), " ".join([*base[:50], "changed", *base[51:]])]
    sets = list(near.shingles.of_all(texts))
    fp = [simhash.of_hashes(s) for s in sets]
    bit = [[sum(int(h) >> b & 1 for h in s.tolist()) * 2 > len(s) for b in range(64)] for s in sets]
    assert fp == [sum(v << b for b, v in enumerate(row)) for row in bit]
    sure = sum((fp[i] ^ fp[i + 1]).bit_count() <= 5 for i in range(0, 80, 2))
    asked, left, was, rest = [], [], simhash.near_pairs, near.apart

    def pairs(fps, bits, matches, *more):
        asked.append(({r.fp for r in fps.collect()}, bits, matches))
        return was(fps, bits, matches, *more)

    def others(found, roots):
        left.append(roots.where("sig <> root").count())
        return rest(found, roots)

    monkeypatch.setattr(simhash, "near_pairs", pairs)
    monkeypatch.setattr(near, "apart", others)
    got = corpus_pipeline.near_stage(spark, frame(spark, list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 80, 2))
    assert asked == [({int(x) - (x >> 63 << 64) for x in fp}, near.BITS, near.MATCHES)]
    assert 0 < sure <= left[0] < 40  # what the index links, before the rest is completed
