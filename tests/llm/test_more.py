"""Warm caches, cuts through repeated rows, scattered license words, and where intermediate tables go."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliant.llm import common, license_scan, mixing, token_count


def test_a_warm_cache_filters_what_it_knows(spark):
    digests = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("content"))
    wanted = digests.limit(500)
    kept = {r["content"] for r in common.maybe_in(digests, wanted, "content").collect()}
    assert {r["content"] for r in wanted.collect()} <= kept and len(kept) < 520
    assert common.maybe_in(digests, wanted.limit(0), "content").count() == 0
    assert common.without(digests, wanted, "content").count() == 2500 and common.without(digests, wanted.limit(0), "content").count() == 3000
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), common.new_path(spark, "token-cache")
    first = spark.createDataFrame([(i, f"text number {i % 40}") for i in range(100)] + [(None, None), (7, "")], "doc_id long, text string")
    more = first.unionByName(spark.createDataFrame([(200 + i, f"other text {i} text") for i in range(30)], "doc_id long, text string"))
    cold = token_count.count_tokens(first, cache, path).collect()
    assert len(cold) == 102 and spark.read.parquet(cache).count() == 41
    warm = token_count.count_tokens(more, cache, path).collect()
    assert len(warm) == 132 and spark.read.parquet(cache).count() == 71
    assert Counter(cold) <= Counter(warm)
    again = token_count.count_tokens(more, cache, path).collect()
    assert Counter(again) == Counter(warm) and spark.read.parquet(cache).count() == 71


def test_a_cut_through_repeated_rows(spark):
    """A source that is one row, a thousand times: as many are taken as the budget holds."""
    rows = [(1, "five words in this text", "a")] * 1000 + [(i, "w " * 10, "b") for i in range(400)] + [(i, "w " * 10, None) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(frame, [1, 2, 4]).collect()
    assert len(mixed) == len(rows)
    for source in ("a", "b", None):
        mine = [r for r in mixed if r["source"] == source]
        taken = sum(r["_copies"] * r["_size"] for r in mine)
        assert abs(taken - mine[0]["_target"]) <= 10 and {r["_copies"] for r in mine} <= {0, 1, 2, 3}


def test_scattered_words_are_no_license():
    wanted = {k: license_scan.words_of(v) for k, v in license_scan.TEMPLATES.items()}
    far = ("filler " * 5000).join(["", "released ", "under ", "mit ", "license ", ""])
    for text in (far, "the photo was licensed in 1990 and later taken under a bridge by nc 4.0 cc machines"):
        assert license_scan.find_licenses(text, wanted, 0.8)[1:] == (None, None, None, None, None, [])
    near = f"under {'filler ' * 400} Released under the MIT License. {'filler ' * 400} license"
    assert license_scan.find_licenses(near, wanted, 0.8)[1:6] == ("MIT-line", 1.0, 5, 401, 405)
    assert license_scan.find_licenses("released today under the MIT license", wanted, 0.8)[1] == "MIT-line"
    for name, text in license_scan.TEMPLATES.items():
        assert name in {x["license"] for x in license_scan.find_licenses(f"{'filler ' * 50}{text} {'filler ' * 50}", wanted, 0.8)[6]}, name


def test_intermediate_tables_go(spark):
    kept = common.materialize(spark.range(3), "test")
    assert kept.count() == 3
    path = common.new_path(spark, "other")
    common.drop_intermediates(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        common.shared_dir(Session())


SIX = {  # sentences that differ from another license's in a word
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0": "CC-BY-4.0", "Released under the BSD License.": "BSD", "Apache License, Version 1.1": "Apache-1.1", "GNU General Public License, version 2": "GPL-2.0", "GNU Lesser General Public License, version 2.1": "LGPL-2.1",
}


def license_of(name):
    return name.split("-short")[0].removesuffix("-long").removesuffix("-line").removesuffix("-notice")


@pytest.mark.parametrize("text", SIX)
def test_the_word_that_matters(text):
    wanted = {k: license_scan.words_of(v) for k, v in {**license_scan.TEMPLATES, **license_scan.short_notices()}.items()}
    for whole in (text, f"This file is licensed under the {text.removeprefix('Licensed under ').removeprefix('Released under the ')} {'and more words ' * 30}"):
        found = {license_of(x["license"]) for x in license_scan.find_licenses(whole, wanted, 0.8)[6]}
        assert found <= {SIX[text]}, (whole, found)
        assert found or whole == text


def test_every_short_notice_is_told_from_every_other():
    templates = {**license_scan.TEMPLATES, **license_scan.short_notices()}
    wanted = {k: license_scan.words_of(v) for k, v in templates.items()}
    same = [{"BSD", "BSD-2-Clause", "BSD-3-Clause"}, {"MIT", "MIT-warranty"}, {"LGPL", "LGPL-2.1"}]
    for name, text in templates.items():
        found = {license_of(x["license"]) for x in license_scan.find_licenses(f"{'filler ' * 20}{text} {'filler ' * 20}", wanted, 0.8)[6]}
        alike = next((s for s in same if license_of(name) in s), set()) | {license_of(name)}
        assert license_of(name) in found and found <= alike, (name, found)


def test_identifier_lines():
    wanted = {k: license_scan.words_of(v) for k, v in license_scan.TEMPLATES.items()}
    text = "a b SPDX-License-Identifier: MIT OR Apache-2.0\nx SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 y"
    found = license_scan.find_licenses(text, wanted, 0.8)
    assert [(x["license"], x["first_word"], x["last_word"]) for x in found[6]] == [("MIT", 5, 5), ("Apache-2.0", 7, 8), ("GPL-2.0-only", 13, 15), ("Classpath-exception-2.0", 17, 19)]
    words = license_scan.words_of(text)
    assert all(words[x["first_word"] : x["last_word"] + 1] == license_scan.words_of(x["license"]) for x in found[6])
    assert license_scan.find_licenses("SPDX-License-Identifier: ", wanted, 0.8)[1:6] == (None,) * 5


def test_near_duplicates_of_the_tables(spark):
    """Over all texts of sf0.01, against brute force on their five-word sets: near texts are one group (0.9 of them at least, and
    here all), and no group holds a text that isn't near to another of it."""
    import numpy as np

    from foliant.llm import simhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    roots = {r["doc_id"]: r["root"] for r in simhash.near_duplicate_classes(docs).collect()}
    sets = {r["doc_id"]: set(simhash.shingle_set(r["text"] or "").tolist()) for r in docs.collect()}
    at: dict = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    both = Counter((a, b) for ids in at.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    share = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in both.items()}
    near = [p for p, j in share.items() if j >= 0.8]
    found = np.mean([roots[a] == roots[b] for a, b in near])
    assert len(near) > 50 and found >= 0.9, (len(near), found)
    members = Counter(roots.values())
    close = {i for p, j in share.items() if j >= 0.78 and roots[p[0]] == roots[p[1]] for i in p}
    assert all(members[r] == 1 or i in close or not sets[i] for i, r in roots.items())


def test_words_that_are_met_again_are_not_encoded_again(monkeypatch):
    """However many other words come between: a generation of the memo hands on what the next one meets. The ids are the library's."""
    import numpy as np
    import public_tokenizers

    from foliant.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_WORDS", 50)
    tokenizer, sent = tokens.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), []
    whole = tokenizer._whole
    monkeypatch.setattr(tokenizer, "_whole", lambda texts: sent.extend(texts) or whole(texts))
    texts = [" ".join(["always", *(f"{k}{a}{b}" for a in "abcdefg" for b in "hijklm")]) for k in "pqrstuvw"]
    got = [tokenizer.ids([x])[0] for x in texts[:1]]
    assert any("always" in x for x in sent)
    sent.clear()
    got += [tokenizer.ids([x])[0] for x in texts[1:]]
    assert len(sent) >= 7 and not any("always" in x for x in sent)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in tokenizer.library.encode_batch_fast(texts, add_special_tokens=False)]


def test_near_duplicates_are_found_by_blocks_of_simhash_bits():
    """A block is the surest bit, with its value, of two groups of SimHash bits; near sets share one, others none."""
    import numpy as np

    from foliant.llm import simhash

    rng = np.random.default_rng(5)
    matrix = np.kron(simhash._TURN, simhash._TURN).astype(np.int64)
    assert (matrix @ matrix.T == simhash.SIDE**2 * np.eye(simhash.SIDE**2)).all()

    def blocks(sums):
        planes = [matrix @ (sums[k % len(sums)] * s).astype(np.int64) for k, s in enumerate(simhash._WAY_SIGNS[len(sums) :])]
        halves = [(v[: simhash.GROUP], v[simhash.GROUP :]) for v in planes]
        return [tuple((int(np.abs(h).argmax()), bool(h[np.abs(h).argmax()] > 0)) for h in pair) for pair in halves]

    shared, chance = [], []
    for n in (5, 6, 9, 18, 90, 900):
        for _ in range(60):
            drawn = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            one, two = drawn[:n], np.concatenate([drawn[: -(-8 * n // 9)], drawn[n : n + n // 9]])
            assert 10 * len(np.intersect1d(one, two)) >= 8 * len(np.union1d(one, two))
            a, b, other = (simhash.plane_sums(x) for x in (one, two, drawn[n:]))
            shared.append(int((simhash.bit_blocks(a) == simhash.bit_blocks(b)).sum()))
            chance.append(int((simhash.bit_blocks(a) == simhash.bit_blocks(other)).sum()))
        exact = [((k * 1024 + 2 * x + p) * 1024) + 2 * y + q for k, ((x, p), (y, q)) in enumerate(blocks(a))]
        assert simhash.bit_blocks(a).tolist() == exact
        signs = np.concatenate([matrix @ (v * s).astype(np.int64) > 0 for v, s in zip(a, simhash._WAY_SIGNS, strict=False)])
        assert simhash.wide_fingerprint(a) == np.packbits(signs, bitorder="little").tobytes()
    assert min(shared) > 0 and np.mean(chance) < 0.01


def test_members_that_meet_by_chance_are_sifted_by_their_first_bits(spark, monkeypatch):
    from foliant.llm import simhash

    near, far = (1 << 20) - 1, -1  # 20 and 64 bits from zero
    monkeypatch.setattr(simhash, "WAYS", 2)
    key = lambda *blocks: b"".join(x.to_bytes(4, "little") for x in blocks)
    rows = [(1, 9, 0, 0, key(5, 6)), (2, 9, near, near, key(5, 7)), (3, 9, far, far, key(5, 6)), (4, 9, far, far, key(8, 7))]
    classes = spark.createDataFrame(rows, "cid long, size long, low long, high long, keys binary")
    assert sorted((r["way"], r["cid"], r["n"]) for r in simhash._buckets(classes).collect()) == [(0, 1, 2), (0, 2, 2)]
    monkeypatch.setattr(simhash, "SIEVED", 2)
    assert sorted((r["way"], r["cid"], r["n"]) for r in simhash._buckets(classes).collect()) == [(0, 1, 3), (0, 2, 3), (0, 3, 3)]
