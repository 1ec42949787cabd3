"""Parity-sketch join, fill-in-the-middle and bisector tournament against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import bisectors, fim, parity_join
from foliant.llm.simhash import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "ONE"), (5, "two words"), (6, "two  Words"), (7, "a b c a b c"), (8, "a b c a b c"), (8, "a b c a b c"), (None, "a b c A b c"), (None, "no id here at all"), (None, None), (9, "x" * 40_000), (10, "w " * 9_000), (11, "Ein\x0bWort \x1f é 日本"), (12, "<P> in it"), (13, "é" * 3000 + "日本語\n" * 500)]


def plain_components(rows):
    """component of each row, by brute force over all pairs of rows."""
    sets = []
    for _, text in rows:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(rng, words, share):
    """Scattered changes, or a passage put before, behind or into the middle, or cut away, of about so many shingles."""
    k, kind = int(share * len(words)), rng.randrange(5)
    if kind == 0:
        out = list(words)
        for i in rng.sample(range(len(words)), max(1, k // 6)):
            out[i] = f"z{rng.random()}"
        return out
    more, at = [f"n{rng.random()}" for _ in range(k)], rng.randrange(len(words))
    return [more + words, words + more, words[:at] + more + words[at:], words[k:]][kind - 1]


def join_rows(seed):
    rng, rows = random.Random(seed), list(ODD)
    for n in (3, 7, 12, 20, 60, 200, 700, 2500):
        for _ in range(5):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            rows.append((100 + len(rows), " ".join(words)))
            for share in (0.02, 0.05, 0.09, 0.1, 0.105, 0.11, 0.13, 0.3):
                rows.append((100 + len(rows), " ".join(edited(rng, words, share))))
    # a chain and a crowd: each differs a little from the one before, and from a template
    words = [f"c{i}" for i in range(300)]
    for i in range(60):
        rows.append((5000 - i, " ".join(words[4 * i :] + [f"d{k}" for k in range(4 * i)])))
        rows.append((6000 - i, " ".join([*words[: 3 * i], f"e{i}", *words[3 * i :]])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_exact(spark, seed):
    rows = join_rows(seed)
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, size int, block int, n_shingles int")
    got = [tuple(r) for r in parity_join.join_near(frame).collect()]
    assert sorted(got, key=repr) == sorted(plain_components(rows), key=repr)


def test_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert parity_join.join_near(none).count() == 0
    assert [tuple(r) for r in parity_join.join_near(none.unionByName(spark.createDataFrame([(3, None)], none.schema))).collect()] == [(3, 0, 3)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4000), st.floats(0, 0.2), st.randoms(use_true_random=False))
def test_near_sets_agree_in_a_word(n, share, rng):
    """Sketches never tell more than the sets, and near sets have a whole word in common in a band of both."""
    one = [rng.getrandbits(64) for _ in range(n)]
    two = one[: n - int(share * n / 2)] + [rng.getrandbits(64) for _ in range(int(share * n / 2))]
    a, b = (np.unique(np.array(x, np.uint64)) for x in (one, two))
    apart = len(set(one) ^ set(two))
    for scope in set(parity_join.scopes(len(a))) | set(parity_join.scopes(len(b))):
        assert int(np.bitwise_count(parity_join.sketch(a, scope) ^ parity_join.sketch(b, scope)).sum()) <= apart
    if parity_join.near(a, b):
        assert apart <= parity_join.allowed(len(a), len(b))
        common = set(parity_join.scopes(len(a))) & set(parity_join.scopes(len(b)))
        assert any((parity_join.sketch(a, k) == parity_join.sketch(b, k)).any() for k in common)


def test_every_near_pair_of_sizes_has_a_band():
    for a in [*range(1, 400), 5000, 77_777, 1_000_000]:
        for b in {a, parity_join.largest_partner(a)}:
            common = set(parity_join.scopes(a)) & set(parity_join.scopes(b))
            assert common and all(parity_join.sketch_words(k) > parity_join.allowed(a, b) for k in common if k == parity_join.band(a)), (a, b)


def test_fill_in_middle(spark):
    rows = [*ODD, *((i, f"{i} some text é日本 " * (i % 7)) for i in range(100, 400)), (14, "a<S"), (15, "<M"), (16, ">P<")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    made = fim.to_middle(frame).withColumn("extra", F.lit(1))
    back = fim.from_middle(made)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in back.collect()), key=repr)
    want = []
    for doc, text in rows:
        text, h = text or "", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        n = len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "plain" if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        cuts = (None, None) if form == "plain" else (a, b - a)
        want.append((doc, n, form, *cuts, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert sorted(r["restored"] for r in back.collect()) == sorted(t or "" for _, t in rows)
    assert fim.from_middle(fim.to_middle(frame.limit(0))).count() == 0


@given(st.text("<>PSMaé日", max_size=12), st.text("<>PSMaé日", max_size=12), st.text("<>PSMaé日", max_size=12), st.sampled_from(["psm", "spm"]))
def test_arrangements_invert(prefix, middle, suffix, form):
    """Pieces that put together hold no sentinel come back, whatever stands beside the sentinels."""
    text = prefix + middle + suffix
    if any(s.decode() in text for s in fim.SENTINELS):
        return
    data, marks = text.encode(), b"".join(fim.SENTINELS)
    parts = fim.cut((fim.TEXT, 0, len(data)), (len(prefix.encode()), len((prefix + middle).encode())))
    out = fim.spell((data, marks), fim.arrange(parts, form))
    assert fim.digest((data, marks), fim.arrange(parts, form)) == hashlib.sha256(out).hexdigest()
    again = fim.restore(fim.arranged_pieces(out, form), form)
    assert [fim.spell((out,), [p]).decode() for p in again] == [prefix, middle, suffix]


def plain_clusters(vectors, k, rounds):
    """(id, cluster, distance) and centroids, by all distances in Python's integers."""
    ordered = sorted(vectors, key=lambda v: (hashlib.sha256(f"1:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))
    centroids = [v for _, v in ordered[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        won = [nearest(v)[1] for _, v in vectors]
        for i in range(len(centroids)):
            if mine := [v for (_, v), w in zip(vectors, won, strict=True) if w == i]:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in vectors], centroids


def test_clusters(spark):
    rng = random.Random(5)
    bad = [None, [], [1.0] * 63, [1.0] * 65, [float("nan")] + [0.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63]
    good = [[rng.gauss(m, 1) for _ in range(64)] for m in (0, 0, 3, -2) for _ in range(40)] + [[0.5] * 64] * 30 + [[-0.0] * 64, [1e9] * 64, [-1e300] * 64, [2.0**20] * 64]
    rows = [(i, v, 1, 1.0) for i, v in enumerate(good + bad)] + [(None, good[0], 1, 1.0), (7, good[7], 1, 1.0), (7, good[8], 1, 1.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, distance double")
    held = [(i, [max(-(1 << 27), min(1 << 27, int(np.floor(min(1e300, max(-1e300, 64 * x)))))) for x in v]) for i, v, _, _ in rows if v is not None and v not in bad]
    for k, rounds in ((16, 3), (3, 1), (1, 2), (500, 1)):
        got = bisectors.cluster_vectors(frame, k=k, rounds=rounds).collect()
        want, centroids = plain_clusters(held, k, rounds)
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == sorted(want, key=repr)
        for r in got:
            assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
            total = sum(d for _, c, d in want if c == r["cluster"])
            assert r["cluster_inertia"] == (total if total < 1 << 63 else None)
    assert bisectors.cluster_vectors(frame.limit(0)).count() == 0
    assert bisectors.cluster_vectors(frame.where("size(embedding) = 63")).count() == 0


def test_a_tie_goes_to_the_smaller_number():
    centroids = [[0, 2], [2, 0], [0, 2], [-2, 0], [0, -2]]
    x = np.array([[0, 0], [1, 1], [3, 0], [-1, -1], [0, 2]], np.int64)
    assert bisectors.winners(x, *bisectors.bisectors(centroids)).tolist() == [0, 0, 1, 3, 0]


def test_sets_hash_whole_short_texts():
    assert len(shingle_set("a b", 3)) == 1 and shingle_set("a b", 3).tolist() != shingle_set("a", 3).tolist()
