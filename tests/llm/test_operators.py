"""Every operator against a plain version, over sf0.001 and over small tables of odd cases."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from foliant.llm import common, graph, license_scan, media, mixing, packing, pii, quality, sharding, simhash, token_count, tokens, url_filter
from foliant.llm import queries as llm_queries
from foliant.llm.common import new_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, "a"), (4, "one", "en", None), (5, "Ein Wort\x0bzwei\x0cdrei \x1f vier\u00a0fünf", "de", "b"),
    (6, "a b c a b c", "en", "a"), (7, "a b c a b c", "en", "a"), (7, "a b c a b c", "en", "a"), (None, "no id", "en", "b"), (None, None, None, None),
    (8, "İstanbul Ⱥ Σας 日本語 <|endoftext|> e\u0301 ½ '\u2019s don't", "en", "c"), (9, "x" * 30000, "en", "c"), (10, "w " * 9000, "en", "c"), (11, "the cat\nthe cat\n\n \nthe cat # $", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, la, s, "x", "y", 3, 4, 5, 6, None) for i, t, la, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string, content string, size long, n int, row long, n_chars long, spans string")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def result(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


def test_urls(spark):
    rules = url_filter.rules_frame(spark, [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/x/")])
    urls = [None, "", "example.net/en/", "http://A.Example.NET/en/1?q=/en/x/", "x://example.net", "x://example.net/", "x://example.net/en", "x://badexample.net/en/", "x://.net/a", "x://a.net.org/", "x:////en/", "http://example.net/en/x/y/z#f", "http://example.net/en/x/y/z#f", "y://z://net/"]
    pages = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(urls)], "page_id int, url string, seen string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"[^/?#]*", rest)[0].lower(), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h + p, v) for v, h, p in [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/x/")] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, *(max(fits)[1:] if fits else (None, "allow"))), u
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_memo_is_the_library(name, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, ours = Tokenizer.from_file(path), tokens.WordTokenizer(path)
    every = "".join(f"{chr(c)}a {chr(c)}{chr(c)} 1{chr(c)}\n " for c in range(0x300))
    cases = [t or "" for _, t, _, _ in docs] + [t or "" for _, t, _, _ in ODD] + [every, "  a  \n\n b \t", "''s's 'S 'RE 're", "<|endoftext|>x <|startoftext|>", *(f"a{chr(c)}b {chr(c)}" for c in range(0x250))]
    for text, got in zip(cases, ours.ids(cases), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_token_counts(spark, odd, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, cache = Tokenizer.from_file(path), new_path(spark, "cache")
    first = odd.where("doc_id < 8")
    for table in (first, odd, odd):  # cold, partly warm, warm
        got = token_count.count_tokens(table, cache, path).collect()
        want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in table.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_count.read_cache(spark, cache).count() == len({t or "" for _, t, _, _ in ODD})  # each content once
    assert token_count.count_tokens(odd.limit(0), new_path(spark, "cache"), path).count() == 0


def check_packing(rows, texts, library, capacity):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    for i, t in texts:
        if i is None:
            continue
        ids = np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]})
        assert mine == [(k, k * capacity, len(p := ids[k * capacity : (k + 1) * capacity]), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // capacity))]
    return len(at), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(spark, odd, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    used, least = check_packing(result(spark, "op3_best_fit_packing"), [(i, t) for i, t, _, _ in docs], library, 4096)
    assert used <= least + 1
    check_packing(packing.pack_documents(odd, path, 64).collect(), [(i, t) for i, t, _, _ in ODD], library, 64)
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_supersteps_over_many_ranges_are_one_stack(spark):
    """A sweep that is dealt over ranges places each document where one stack over the whole order does."""
    rng = np.random.default_rng(5)
    for n_docs, n_slots, top in ((700, 300, 40), (300, 700, 40), (500, 500, 3), (400, 0, 9), (0, 9, 9)):
        docs = [(int(i), int(x)) for i, x in enumerate(rng.integers(1, top, n_docs))]
        slots = [(int(i), int(x), int(x + rng.integers(0, 3))) for i, x in enumerate(rng.integers(1, top, n_slots))]
        events = sorted([(-x, 0, -room, s) for s, x, room in slots] + [(-x, 1, 0, r) for r, x in docs])
        free, want = [], {}
        for _, is_doc, _, k in events:
            if not is_doc:
                free.append(k)
            else:
                want[k] = free.pop() if free else None
        frames = spark.createDataFrame(docs, "row long, length long"), spark.createDataFrame(slots, "sequence long, size long, room long")
        for range_rows in (10_000, 90):
            got = {r["row"]: r["sequence"] for r in packing.superstep(*frames, n_docs + n_slots, range_rows).collect()}
            assert got == want, (n_docs, n_slots, range_rows)


def test_packing_against_best_fit_decreasing(spark):
    rng = np.random.default_rng(7)
    for capacity, lengths in ((64, rng.integers(1, 65, 600)), (100, np.minimum(100, rng.geometric(0.05, 800))), (64, np.full(300, 23)), (10, np.array([6, 4] * 50 + [1]))):
        rooms: list[int] = []
        for length in sorted(lengths.tolist(), reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= length]
            k = min(fits, key=lambda k: rooms[k]) if fits else len(rooms)
            if not fits:
                rooms.append(capacity)
            rooms[k] -= length
        pieces = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "piece long, length int")
        rows = packing.pack(pieces, capacity, range_rows=200).collect()
        assert sorted((r["piece"], r["length"]) for r in rows) == sorted((i, int(x)) for i, x in enumerate(lengths))
        at = defaultdict(list)
        for r in rows:
            at[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in at.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(at) <= 1.01 * len(rooms) + 1, (capacity, len(at), len(rooms))
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(11,)], "length int"), 10)


def test_media(spark, odd, docs):
    rows = media.media_features(media.text_media(odd)).collect()
    assert len(rows) == len(ODD)
    want = Counter()
    for i, t, _, _ in ODD:
        data = (t or "").encode()
        padded = data + b" " * (192 - len(data) if len(data) < 192 else -len(data) % 192)
        want[i, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    stored = media.text_media(odd).collect()
    assert {hashlib.sha256(r["media"]).hexdigest() for r in stored} == {r["media_sha256"] for r in rows}
    assert {bytes(r["media"][:2]) for r in stored} == {b"P6", b"BM"}
    assert media.media_features(media.text_media(odd.limit(0))).count() == 0

    def mean_areas(grid, height, width):
        """By repeating each sample so that areas hold whole numbers of them."""
        fine = np.repeat(np.repeat(grid, height, 0), width, 1)
        return fine.reshape(height, grid.shape[0], width, grid.shape[1], -1).mean((1, 3))

    features = {r["doc_id"]: r for r in result(spark, "op4_media_columns")}
    for i, t, _, _ in docs:
        data = (t or "").encode()
        grid = np.frombuffer(data.ljust(max(1, -(-len(data) // 192)) * 192), np.uint8).reshape(-1, 64, 3).astype(float)
        if len(grid) <= 200:
            grey = np.round(mean_areas(grid, 8, 9).mean(2), 6)
            assert features[i]["feature"] == f"{int(''.join('01'[int(b > a)] for row in grey for a, b in zip(row, row[1:])), 2):016x}", i
            out = io.BytesIO()
            np.save(out, np.rint(mean_areas(grid, 16, 16)).astype(np.uint8))
            near = np.abs(mean_areas(grid, 16, 16) % 1 - 0.5).min() < 1e-6  # a mean that rounds either way
            assert near or (features[i]["tile_sha256"], features[i]["tile_bytes"]) == (hashlib.sha256(out.getvalue()).hexdigest(), len(out.getvalue())), i
    pixels = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all() and (media.decode(media.encode_ppm(pixels)) == pixels).all()
    assert (media.decode(b"P2 # c\n2 2\n255\n1 2 # x\n3 4") == np.array([[[1], [2]], [[3], [4]]])).all()
    big = np.kron(pixels, np.ones((4, 3, 1)))
    assert np.allclose(media.area_resize(big, 5, 7), pixels)
    assert np.allclose(media.area_resize(pixels, 1, 1)[0, 0], pixels.mean((0, 1)))


def test_shards(spark, odd, docs):
    rows = result(spark, "op5_kd_sharding")
    check_shards(rows, docs)
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 4 * max(r["size"] for r in rows)
    check_shards(sharding.kd_shards(odd, ["source", "lang", "n_chars"], target_bytes=20_000).collect(), ODD)
    assert sharding.kd_shards(odd.limit(0), ["source"], shards=8).count() == 0
    same = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
    parts = Counter(r["shard"] for r in sharding.kd_shards(same, ["source"], shards=5).collect())
    assert sorted(parts) == [0, 1, 2, 3, 4] and max(parts.values()) < 1.1 * min(parts.values())


def test_shards_are_boxes_of_whole_values(spark):
    """Strings count whole, however long their common beginning, and null lies apart from '': two shards split eight names
    into the first four and the last four, and three values of a number into null, below and above."""
    names = [None, "", *(f"common-crawl-{c}" for c in "abcdef")]
    frame = spark.createDataFrame([(i, "text", names[i % 8], float("nan") if i % 50 == 0 else float(i % 8)) for i in range(4000)], "doc_id long, text string, name string, x double")
    at = defaultdict(Counter)
    for r in sharding.kd_shards(frame, ["name"], shards=4).join(frame.select("doc_id", "name"), "doc_id").collect():
        at[r["shard"]][r["name"] or repr(r["name"])] += 1
    for k, pair in enumerate((("''", "None"), ("common-crawl-a", "common-crawl-b"), ("common-crawl-c", "common-crawl-d"), ("common-crawl-e", "common-crawl-f"))):
        assert sum(at[k][x] for x in pair) > 0.99 * sum(at[k].values()), at  # a row at the cut may go either way
    parts = sharding.kd_shards(frame, ["x", "name"], shards=7).collect()
    assert sorted(Counter(r["shard"] for r in parts)) == list(range(7)) and len(parts) == 4000


def test_shards_against_plain_splits(spark):
    """Along one dimension of distinct values the shards are runs whose ends are nearest, from below, to the halves of the bytes."""
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 60, 900)
    frame = spark.createDataFrame([(int(i), "x" * (int(s) - 1)) for i, s in enumerate(sizes)], "doc_id long, text string")
    got = [s for _, s in sorted((r["doc_id"], r["shard"]) for r in sharding.kd_shards(frame, ["doc_id"], shards=8).collect())]

    def split(a, b, shards):
        if shards == 1 or a == b:
            return [b - a] if shards == 1 else [0] * shards
        before, wanted = np.cumsum([0, *sizes[a:b]]), int(sizes[a:b].sum()) * (shards // 2) // shards
        cut = a + int(np.searchsorted(before, wanted, side="right"))
        return split(a, cut, shards // 2) + split(cut, b, shards - shards // 2)

    assert got == sorted(got) and list(Counter(got).values()) == split(0, 900, 8)


def check_shards(rows, docs):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_stats(text):
    words = WORD.findall(text)
    seen, repeats = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2)), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            repeats |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeats)


def test_quality(spark, odd, docs):
    for rows, table in ((result(spark, "op6_quality_rules"), docs), (quality.judge_quality(odd, F.col("doc_id").alias("doc_id")).withColumnRenamed("_k0", "doc_id").collect(), ODD)):
        want = Counter()
        for i, t, _, _ in table:
            s = plain_stats(t or "")
            want[i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]] += 1
        assert Counter((r["doc_id"], *(r[k] for k in quality.STATS), r["base_failed"]) for r in rows) == want
        assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.judge_quality(odd.limit(0), F.col("doc_id")).count() == 0


def test_outliers_against_plain_concentration(spark):
    """A normal cloud with a tenth far away: the far ones go, the others stay, and distances are those of plain numpy steps."""
    rng = np.random.default_rng(3)
    z = np.rint(rng.normal([5, 1.6, 1, 0.4, 0.4], [1, 0.5, 1, 0.2, 0.2], (2000, 5)) * quality.UNIT).astype(int)
    z[:200] += np.array([5, 3, 6, 2, 2]) * quality.UNIT
    rows = [("en", "s", False, *map(int, v)) for v in z] + [("en", "tiny", False, 1, 2, 3, 4, 5), (None, None, True, 0, 0, 0, 0, 0)]
    stats = spark.createDataFrame(rows, "_lang string, _source string, base_failed boolean, z0 long, z1 long, z2 long, z3 long, z4 long")
    known, estimates = quality.fit_outliers(stats)
    est = [r for r in estimates.collect() if "tiny" not in r["grp"] and "s" in r["grp"]]
    assert len(est) == 1
    x = z / quality.UNIT
    inverse = np.array(est[0]["inverse"]).reshape(5, 5)
    d = np.einsum("ni,ij,nj->n", x - est[0]["mean"], inverse, x - est[0]["mean"])
    cut = quality.chi_square(quality.TAIL)
    assert d[:200].min() > cut * est[0]["scale"] and np.mean(d[200:] > cut) == 0 and 3.0 < np.median(d[200:]) < 6.0 and est[0]["scale"] < 1.3
    near = x[np.argsort(d)[:1500]]  # a further plain step changes next to nothing
    assert np.allclose(near.mean(0), est[0]["mean"], atol=0.05)
    best = np.inf  # and no other start of plain steps finds a smaller determinant
    for start in range(20):
        some = x[rng.choice(len(x), 12, replace=False)]
        mean, cov = some.mean(0), np.cov(some.T) + 1e-3 * np.eye(5)
        for _ in range(20):
            near = x[np.argsort(np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean))[:1500]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True)
        best = min(best, np.linalg.slogdet(quality.CONSISTENCY * cov)[1])
    assert -np.linalg.slogdet(inverse)[1] < best + 0.1


def test_chi_square():
    assert abs(quality.chi_square(0.5) - 4.3515) < 0.001 and abs(quality.chi_square(0.001) - 20.515) < 0.001 and abs(quality.chi_square(0.05, 3) - 7.815) < 0.001 and abs(quality.chi_square(0.05, 4) - 9.488) < 0.001


def test_two_clusters_settle_on_the_larger(spark):
    """Medians lie between two clusters; the estimate is of the larger one, and all of the smaller one goes."""
    rng = np.random.default_rng(9)
    z = np.rint(rng.normal([5, 1.6, 1, 0.4, 0.4], [0.4, 0.1, 0.5, 0.1, 0.1], (1000, 5)) * quality.UNIT).astype(int)
    z[:240] += np.array([4, 2, 5, 2, 2]) * quality.UNIT
    stats = spark.createDataFrame([("en", "s", False, *map(int, v)) for v in z], "_lang string, _source string, base_failed boolean, z0 long, z1 long, z2 long, z3 long, z4 long")
    known, estimates = quality.fit_outliers(stats)
    far = known.join(estimates, "grp").where(quality._distance() / F.col("scale") > quality.chi_square(quality.TAIL)).collect()
    assert Counter(tuple(r[f"z{i}"] for i in range(5)) for r in far) == Counter(tuple(map(int, v)) for v in z[:240])


def test_small_sources_and_rare_languages_are_judged(spark):
    """Sources of a few rows beside a large one, a rare language, and a whole table of a few rows: each row has a distance,
    and junk goes whatever its group's size."""
    rng = np.random.default_rng(6)
    kinds = "_lang string, _source string, base_failed boolean, z0 long, z1 long, z2 long, z3 long, z4 long"

    def rows(lang, source, n, junk=0):
        z = np.rint(rng.normal([5, 1.6, 1, 0.4, 0.4], [1, 0.5, 1, 0.2, 0.2], (n, 5)) * quality.UNIT).astype(int)
        z[:junk] += np.array([8, 6, 9, 3, 3]) * quality.UNIT
        return [(lang, source, False, *map(int, v)) for v in z]

    table = rows("en", "hot", 1500) + rows("en", "small", 20, 6) + rows("en", None, 20, 6) + rows("fi", "hot", 20, 6) + rows(None, None, 20, 6) + [("xx", "failed", True, 0, 0, 0, 0, 0)]
    for cases, junk in ((table, 24), (rows("en", "only", 20, 3), 3)):
        known, estimates = quality.fit_outliers(spark.createDataFrame(cases, kinds))
        judged = known.join(estimates, "grp", "left").withColumn("distance", quality._distance() / F.col("scale")).where("not base_failed").collect()
        assert len(judged) == sum(not r[2] for r in cases) and all(r["distance"] is not None for r in judged)
        assert sum(r["distance"] > quality.chi_square(quality.TAIL) for r in judged) == junk


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = [w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in prints}


def test_simhash(spark, odd, docs):
    for rows, table in ((result(spark, "op7_simhash_dedup"), docs), (simhash.link_fingerprints(simhash.fingerprints(odd)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id").collect(), ODD)):
        prints = [(i, plain_fingerprint(t or "")) for i, t, _, _ in table]
        roots = plain_components({f for _, f in prints})
        least = {}
        for i, f in prints:
            if i is not None:
                least[roots[f]] = min(i, least.get(roots[f], i))
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == Counter((i, f"{f:016x}", least.get(roots[f])) for i, f in prints)
    assert simhash.link_fingerprints(simhash.fingerprints(odd.limit(0))).count() == 0


def test_links_in_crowded_buckets_and_chains(spark):
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 1 << 63, 3).tolist():
        for _ in range(400):  # a crowd around each
            prints.add(base ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)).tolist())))
    chain = 0
    for i in range(60):  # a long chain
        chain ^= 3 << i
        prints.add(chain)
    prints = sorted(prints)
    rows = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(prints)]
    got = simhash.link_fingerprints(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    roots, least = plain_components(set(prints)), {}
    for k, f in enumerate(prints):
        least.setdefault(roots[f], k)
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: least[roots[f]] for k, f in enumerate(prints)}


def test_near_duplicates(spark, odd):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(5000)]
    rows, group = [], {}
    for g in range(40):
        base = rng.choice(words, 300).tolist()
        for copy in range(rng.integers(1, 5)):
            text = list(base)
            for at in rng.integers(0, 300, 3 if copy else 0):
                text[at] = str(rng.choice(words))
            group[len(rows)] = g
            rows.append((len(rows), " ".join(text), "en", "s", 1))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(table).collect()]
    assert sorted(kept) == sorted({g: i for i, g in reversed(group.items())}.values())
    left = simhash.drop_near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 1, 4, 5, 6, 8, 9, 10, 11] and set(left[0].asDict()) == set(odd.columns)
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_by_kind_of_edit(spark):
    """One contiguous passage more or less, with similarities closely around 0.8, against brute force."""
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(5000)]
    rows, shingles = [], []
    for g in range(240):
        base = rng.choice(words, rng.integers(60, 400)).tolist()
        m = len(base) - 4
        share = rng.uniform(0.76, 0.86)
        more, less = rng.choice(words, round(m / share) - m).tolist(), round(m * (1 - share))
        copy = [base + more, more + base, base[: len(base) - less], base[less:], [*base[: m // 2], *more, *base[m // 2 :]]][g % 5]
        for text in (base, copy):
            rows.append((len(rows), " ".join(text), "en", "s", 1))
            shingles.append({tuple(text[i : i + 5]) for i in range(len(text) - 4)})
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    gone = {i for i in range(1, len(rows), 2) if 5 * len(shingles[i] & shingles[i - 1]) >= 4 * len(shingles[i] | shingles[i - 1])}
    assert 80 < len(gone) < 200
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(table).collect()} == set(range(len(rows))) - gone


def test_near_duplicates_across_stars(spark, monkeypatch):
    """Chains and crowds: the components are those of all pairs at 0.8, also where a bucket's least member is near to few."""
    monkeypatch.setattr(simhash, "MEMBERS", 8)
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(5000)]
    template = rng.choice(words, 200).tolist()
    texts = [[*template, *rng.choice(words, 45).tolist()] for _ in range(12)]  # about 0.68 to each other
    for t in list(texts):
        for _ in range(3):
            texts.append([*t[:245], *rng.choice(words, rng.integers(20, 60)).tolist()])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 12 <= len(set(root)) < len(texts)
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(table).collect()} == set(root)


def test_stars_settle_in_one_round(spark):
    """Links of one star are settled as they are: what the driver plans and keeps grows with the rounds."""
    links = spark.createDataFrame([(k, 0) for k in range(1, 50)] + [(7, 7), (0, 3)], "a long, b long")
    before = len(common.tables_made(spark))
    assert {tuple(r) for r in graph.stars(links).collect()} == {(k, 0) for k in range(1, 50)}
    assert len(common.tables_made(spark)) == before + 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(102, 101), (100, 101)], "a long, b long")
    assert {tuple(r) for r in graph.components(chain).collect()} == {(k, 0) for k in range(61)} | {(k, 100) for k in (100, 101, 102)}
    assert graph.stars(links.where("a = b")).count() == 0


def test_plans_of_near_duplicates_stay_small(spark, monkeypatch):
    """The driver keeps each plan, again at each of its steps: none reads more than eight tables, in whatever round."""
    read, write = {}, simhash.materialize

    def counted(df, label):
        read[label] = max(read.get(label, 0), len(re.findall(r"Relation |LogicalRDD", df._jdf.queryExecution().optimizedPlan().toString())))
        return write(df, label)

    for module in (simhash, graph):
        monkeypatch.setattr(module, "materialize", counted)
    words = [f"w{k}" for k in range(400)]
    rows = [(10 * g + i, " ".join([*words[20 * g : 20 * g + 120], *[f"x{g}y{i}z{k}" for k in range(4 * i)]])) for g in range(6) for i in range(6)]
    simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert "doubtful-members" in read
    assert max(read.values()) <= 8, read


def test_plans_of_mixing_quality_and_packing_stay_small(spark, monkeypatch):
    """The driver plans each query anew at each of its steps: a cut reads five tables at most and a quality level's join three; what a
    superstep leaves, and whether the determinants have settled, is asked with one shuffle and none."""
    read, asked = {}, []

    def counted(df, label):
        read[label] = max(read.get(label, 0), len(re.findall(r"Relation |LogicalRDD", df._jdf.queryExecution().optimizedPlan().toString())))
        return common.materialize(df, label)

    def noted(name, plain):
        def call(df, *a, **b):
            asked.append((name, len(re.findall(r"\n?[ :+-]*Exchange ", df._jdf.queryExecution().executedPlan().toString()))))
            return plain(df, *a, **b)

        return call

    kind = type(spark.range(0))
    for module in (mixing, quality, packing):
        monkeypatch.setattr(module, "materialize", counted)
    monkeypatch.setattr(kind, "isEmpty", noted("isEmpty", kind.isEmpty))
    rows = [(k, " ".join(f"w{k % 7}x{i * k % 53}" for i in range(60 + k % 40)), "en" if k % 3 else None, f"s{k % 4}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixing.mix(docs, [5, 2, 1]).collect()
    quality.judge_quality(docs).collect()
    assert read["mix-cuts"] <= 5 and read["mix-ends"] <= 5 and read["quality-shrunk"] <= 3, read
    assert asked and all(n == 0 for _, n in asked), asked
    asked.clear()
    monkeypatch.setattr(kind, "collect", noted("collect", kind.collect))
    pieces = spark.createDataFrame([(k, 1 + k * k % 90) for k in range(300)], "doc_id long, length long")
    packing.pack(pieces, 100)
    assert len(asked) > 2 and all(n == 1 for _, n in asked), asked


def test_tokens_are_looked_up_in_small_parts():
    """A worker lives beside another and the executor's heap: it cuts about a million characters at once."""
    tokenizer, parts = tokens.WordTokenizer(llm_queries.tokenizer("word_bpe_49k.json")), []
    plain = tokenizer._ids
    tokenizer._ids = lambda texts: parts.append(sum(map(len, texts))) or plain(texts)
    texts = [" ".join(f"w{i}q{k}" for k in range(13_000)) for i in range(30)]
    assert tokenizer.ids(texts) == [plain([x])[0] for x in texts]
    assert len(parts) > 1 and max(parts) <= 1_000_000 + max(map(len, texts))


def plain_pii(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
            found.append(("card", m.start(), m.end()))
    return found + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


PII_TEXTS = [
    "a@b.c_d@e.f.g x@y x@y.z. ..@a.b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 00012.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 5", "+1 (523) 555-1055 +49 30 1234567890123456 +1((((( +1 2 3",
    "é日本 a@b.c é +1 (523) 555-1055 😀 4111111111111111", "@" + "a." * 20000 + "b x@" + "a." * 20000 + "b", "9" * 50000, "+1" + " " * 50000, "a" * 50000 + "@", None, "", "1 2 " * 5000, "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, DE89370400440532013001", "ssn 123-45-6789 and 123-45-6789 alone " + "x" * 60 + " 123-45-6780",
]


def test_pii(spark, docs):
    table = docs + [(10_000 + k, t, None, None) for k, t in enumerate(PII_TEXTS)]
    frame = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    spans = {r["doc_id"]: r for r in pii.with_spans(frame).select("doc_id", pii.span_string(F.col("spans")).alias("all"), pii.span_string(F.concat(*[F.col(f"_{k}") for k in pii.BASE_KINDS])).alias("base")).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    for i, t, _, _ in table:
        want = plain_pii(t or "")
        assert spans[i]["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want), (i, (t or "")[:60])
        assert t is None and clean[i] is None or not plain_pii(clean[i]) and (want or clean[i] == t or "iban" in spans[i]["all"] or "ssn" in spans[i]["all"])
    iban = spans[10_012]["all"].split(",")
    assert [x for x in iban if x.startswith("iban")] == ["iban:5:32", "iban:34:56"]
    assert [x for x in spans[10_013]["all"].split(",") if x.startswith("ssn")] == ["ssn:4:15", "ssn:20:31"]
    assert "<iban>, <iban>" in clean[10_012]


def test_iban_before_other_capitals_and_digits(spark):
    one, spaced, other = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    cases = [(f"{iban}{after}", [iban]) for iban in (one, spaced, other) for after in (" I paid", " The rest", " 2024-01-01", " COBADEFFXXX", " 100 EUR", " BIC COBADEFFXXX ON 1 MAY 2024 AND MUCH MORE", "", ".")]
    cases += [(f"{one} {other}", [one, other]), (f"BE12 {spaced} {spaced} X", [spaced, spaced]), (f"NO93 8601 1117 947 {one}", ["NO93 8601 1117 947", one]), (f"{one}A", []), (f"A{one}", []), (one[:-1] + "1 I paid", []), ("AA11 " * 5000, [])]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    spans = {r["doc_id"]: [t for t in r["s"].split(",") if t.startswith("iban")] for r in pii.with_spans(frame).select("doc_id", pii.span_string(F.col("spans")).alias("s")).collect()}
    for k, (text, want) in enumerate(cases):
        assert [text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in spans[k]] == want, text[:60]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert clean[0] == "<iban> I paid" and clean[24] == "<iban> <iban>"


def test_licenses(spark, odd, docs):
    def plain(text, template):
        """The same alignment by recursion."""

        def go(a, b, c, d, bound):
            if a >= b or c >= d:
                return []
            if bound and text[a] == template[c]:
                return [(a, c), *go(a + 1, b, c + 1, d, True)]
            if bound and text[b - 1] == template[d - 1]:
                return [*go(a, b - 1, c, d - 1, True), (b - 1, d - 1)]
            one, two = Counter(text[a:b]), Counter(template[c:d])
            pairs = [(i, template.index(text[i], c, d)) for i in range(a, b) if one[text[i]] == 1 and two[text[i]] == 1]
            best: list = [()] * (len(pairs) + 1)
            for k in range(len(pairs) - 1, -1, -1):
                after = [best[m] for m in range(k + 1, len(pairs)) if pairs[m][1] > pairs[k][1]]
                best[k] = (pairs[k], *max(after, key=len, default=()))
            marks = max(best, key=len)
            if not marks:
                return []
            out = list(marks)
            for (i, j), (m, n) in zip([(a - 1, c - 1), *marks], [*marks, (b, d)]):
                out += go(i + 1, m, j + 1, n, True)
            return sorted(out)

        return go(0, len(text), 0, len(template), False)

    template = license_scan.words_of(license_scan.TEMPLATES["ISC"])
    rng = np.random.default_rng(4)
    for _ in range(30):
        text = [w for w in template if rng.random() > 0.1]
        for at in rng.integers(0, len(text), 4):
            text.insert(int(at), str(rng.choice(["the", "x", "permission", "y"])))
        got, want = license_scan.align(text, template), plain(text, template)
        assert all(text[i] == template[j] for i, j in got) and got == sorted(set(got)) and len(got) == len(want)
    rows = {r["doc_id"]: r for r in result(spark, "op9_license_scan")}
    lines = {n: license_scan.words_of(t) for n, t in license_scan.TEMPLATES.items()}
    for i, t, _, _ in docs:
        for n in ("MIT-line", "Apache-2.0-line", "GPL-3.0-line", "CC-BY-NC-4.0-line"):
            if license_scan.TEMPLATES[n] in (t or ""):
                assert rows[i]["license"] is not None and rows[i]["coverage"] >= 0.8, (i, n, lines[n])
    assert scan_rows(license_scan.scan_licenses(odd)) == [None] * len(ODD) and license_scan.scan_licenses(odd.limit(0)).count() == 0


def test_every_license_and_repeated_notices():
    t = license_scan.TEMPLATES
    wanted = {k: license_scan.words_of(v) for k, v in t.items()}
    filler = " ".join(f"the software w{k} is released under a license of mit or any copy" for k in range(300))

    def found(text):
        return [(x["license"], x["first_word"]) for x in license_scan.find_licenses(text, wanted, 0.8)[6]]

    for name in ("MIT-line", "MIT", "GPL-3.0-notice", "BSD", "Unlicense"):
        n, m = len(wanted[name]), len(license_scan.words_of(filler))
        for text, places in ((f"{t[name]} {t[name]}", [0, n]), (f"{t[name]} {filler} {t[name]}", [0, n + m]), (f"{filler} {t[name]} {filler}", [m])):
            assert [i for x, i in found(text) if x == name] == places, (name, text[:40])
    assert {"MIT", "ISC"} <= {x for x, _ in found(t["MIT"] + " or, at your choice: " + t["ISC"])}
    assert found(filler) == []


def scan_rows(df):
    return [r["license"] for r in df.collect()]


def test_mixing(spark, odd):
    for frame in (odd, odd.limit(0)):
        rows = mixing.mix(frame, [5, 2, 1]).collect()
        assert len(rows) == frame.count()
        sizes = Counter()
        for r in rows:
            assert r["_size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["_copies"] <= 3
            sizes[r["source"]] += r["_size"]
        if rows:
            targets = {r["source"]: r["_target"] for r in rows}
            order = sorted(sizes, key=lambda s: (s is None, s))
            weights, left, level = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, sum(sizes.values()), {}
            free = set(order)
            while True:  # give by weight, stop at three times the size, give the excess again
                share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
                over = {s for s in free if share[s] > 3 * sizes[s]}
                if not over:
                    level |= share
                    break
                level |= {s: 3 * sizes[s] for s in over}
                left -= sum(3 * sizes[s] for s in over)
                free -= over
            assert targets == pytest.approx(level)
        again = mixing.mix(frame.repartition(3), [5, 2, 1]).collect()
        key = lambda r: repr((r["doc_id"], r["text"], r["_copies"]))
        assert sorted(map(key, rows)) == sorted(map(key, again))


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        before, rows = docs.collect(), out.collect()
        if name == "quality rules":
            good = [r for r in before if not (s := plain_stats(r["text"] or ""))[0] < 50 and not 100 * s[4] > 50 * s[0]]
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in good} and len(rows) > 0.7 * len(good)
        if name == "simhash near-dedup":
            assert len({r["text"] for r in rows}) == len(rows) and {r["text"] for r in rows} <= {r["text"] for r in before}
        if name == "pii":
            assert not any(plain_pii(r["text"] or "") for r in rows) and len(rows) == len(before)
        docs = spark.createDataFrame(rows, out.schema)
        kept = rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept}
    for frame in (odd.select(*corpus_pipeline.COLUMNS), odd.select(*corpus_pipeline.COLUMNS).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).collect()
