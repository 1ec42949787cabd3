"""Jaccard join of n-gram sets by parity sketches.

A set's sketch has a bit for each of its places that an odd number of its shingles hash to, so one shingle more or less
turns one bit: two sketches differ in no more bits than their sets differ in shingles. Sets of sizes a and b that are near
differ in at most `allowed(a, b)` shingles. Sizes are cut into bands; a sketch of a band has one 64-bit word more than the
shingles that a near pair of the band may differ in, so such a pair agrees in a whole word (pigeonholes), and the join
is on words. It misses no pair. What shares a word is sifted by the Hamming distance of a second, short sketch of the same
kind (GIST words, whatever the size), and verified by counting on the sets.

Documents of one set are one class throughout. In each of STAR_ROUNDS rounds a class is held against one other, the
centre of one of its buckets; what is linked becomes one part, and members of a bucket that stay in different parts are
then compared within tasks, so that rows grow with the members and not with their pairs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_in, slices, whole_text, without
from .graph import stars
from .simhash import _apart_still, _dealt, _mix, shingle_set

WORDS = 3
#: Near: NEAR[1] * intersection >= NEAR[0] * union.
NEAR = (90, 100)
STAR_ROUNDS = 2
#: Words of the short sketch. Its distance between sets that have little in common is about 32 a word, so it tells apart sets
#: of up to some 4,000 shingles; larger ones are compared by counting wherever they share a word.
GIST = 16
_TURN = np.uint64(0xD6E8FEB86659FD93)


def allowed(one, two):
    """How many shingles near sets of these sizes differ in at most (also for arrays)."""
    return (one + two) * (NEAR[1] - NEAR[0]) // (NEAR[1] + NEAR[0])


def largest_partner(size: int) -> int:
    return size * NEAR[1] // NEAR[0]


_lows = [1]


def band(size: int) -> int:
    """The band of a set of this size (1 or more); a band's sizes are from _lows[band] to _lows[band + 1] - 1."""
    while _lows[-1] <= size:
        _lows.append(max(_lows[-1] + 1, _lows[-1] * 6 // 5))
    return bisect_right(_lows, size) - 1


def sketch_words(scope: int) -> int:
    """Words of a sketch for pairs whose smaller set is of band `scope`."""
    while len(_lows) <= scope + 1:
        band(_lows[-1])
    top = _lows[scope + 1] - 1
    return allowed(top, largest_partner(top)) + 1


def parities(shingles: np.ndarray, words: int, salt: int = 0) -> np.ndarray:
    """For each bit of so many words, whether an odd number of shingles falls on it."""
    n, low = np.uint64(words), np.uint64(32)
    mixed = _mix(shingles ^ (_TURN + np.uint64(salt)))
    place = (((mixed >> low) * n) >> low) * np.uint64(64) + (mixed & np.uint64(63))
    odd = np.bincount(place.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def sketch(shingles: np.ndarray, scope: int) -> np.ndarray:
    return parities(shingles, sketch_words(scope))


def gist(shingles: np.ndarray) -> np.ndarray:
    return parities(shingles, GIST, 1)


def scopes(size: int) -> list[int]:
    """The bands whose pairs a set of this size may belong to: its own, and the one below where it is near enough to it."""
    own = band(size)
    return [own, own - 1] if own and size <= largest_partner(_lows[own] - 1) else [own]


def near(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sets (in order) are near, by counting."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return NEAR[1] * both >= NEAR[0] * (len(one) + len(two) - both)


def set_prints(docs: DataFrame) -> DataFrame:
    """doc_id, content (SHA-256 of the text), n_shingles, digest (of the set; null if empty), its gist, and the words of its sketches:
    own, of its band (scope), and below, of the band below (null where no pair of that can hold it)."""
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["doc_id", "content", "n_shingles", "digest", "gist", "scope", "own", "below"]

    def each(batches):
        for b in slices(batches):
            rows = []
            for x in b.column(2):
                s = shingle_set(x.as_py(), WORDS)
                if not len(s):
                    rows.append((0, *[None] * 5))
                    continue
                where = scopes(len(s))
                made = [sketch(s, k).view(np.int64) for k in where]
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), gist(s).view(np.int64), where[0], made[0], made[1] if len(made) > 1 else None))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.sha2(whole_text(), 256).alias("content"), whole_text().alias("text"))
    return rows.mapInArrow(each, "doc_id long, content string, n_shingles long, digest binary, gist array<bigint>, scope int, own array<bigint>, below array<bigint>")


def _keyed(rows: DataFrame) -> DataFrame:
    """cid, size, way (scope and place of a word) and block (a hash of the way and the word) of the classes `rows`."""

    def words(column: str, scope):
        way = lambda i: F.shiftleft(scope.cast("long"), 32) + i
        return F.transform(column, lambda w, i: F.struct(way(i).alias("way"), F.xxhash64(way(i), w).alias("block")))

    both = F.concat(words("own", F.col("scope")), F.coalesce(words("below", F.col("scope") - 1), F.array().cast("array<struct<way:bigint,block:bigint>>")))
    return rows.select(F.col("rid").alias("cid"), F.col("n_shingles").alias("size"), F.explode(both).alias("w")).select("cid", "size", "w.way", "w.block")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, shingles (in order, 8 bytes each) of the classes `wanted` (cid, doc_id, content): one text of each moves."""

    def each(batches):
        for b in slices(batches):
            found = [shingle_set(x.as_py(), WORDS) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["cid", "shingles"])

    def keyed(rows: DataFrame, content) -> DataFrame:
        return rows.withColumn("_key", F.sha2(F.concat_ws(":", content, F.col("doc_id").cast("string")), 256))

    wanted = keyed(wanted, F.col("content")).select("cid", "_key")
    texts = maybe_in(keyed(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")), F.sha2("text", 256)), wanted, "_key")
    return texts.join(wanted, "_key").groupBy("cid").agg(F.first("text").alias("text")).mapInArrow(each, "cid long, shingles binary")


def _sifted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b whose gists differ in no more bits than near sets may."""

    def each(batches):
        for b in batches:
            one, two = (b.column(k).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, GIST) for k in (2, 3))
            apart = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
            sizes = [b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(apart <= allowed(*sizes)))

    side = lambda k: classes.select(F.col("cid").alias(k), F.col("gist").alias(f"{k}_gist"), F.col("size").alias(f"{k}_size"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    return held.select("a", "b", "a_gist", "b_gist", "a_size", "b_size").mapInArrow(each, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are near."""

    def each(batches):
        for b in slices(batches):
            kept = [near(*(np.frombuffer(v.as_buffer(), np.uint64) for v in xy)) for xy in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    side = lambda k, name: sets.select(F.col("cid").alias(k), F.col("shingles").alias(name))
    return pairs.join(side("a", "one"), "a").join(side("b", "two"), "b").select("a", "b", "one", "two").mapInArrow(each, "a long, b long")


def _sketches(prints: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, size, scope, bits (words) of the classes `wanted` (cid): a row for each band of `scopes`."""
    key = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("_key")
    held = maybe_in(prints.select("rid", "n_shingles", "scope", "own", "below", key("rid")), wanted.select(key("cid")), "_key")
    both = F.array(F.struct("scope", F.col("own").alias("bits")), F.struct((F.col("scope") - 1).alias("scope"), F.col("below").alias("bits")))
    rows = held.join(wanted, F.col("rid") == F.col("cid")).select("cid", F.col("n_shingles").alias("size"), F.explode(both).alias("w"))
    return rows.select("cid", "size", "w.scope", "w.bits").where("bits is not null")


def _apart(dealt: DataFrame, prints: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Of the members `dealt` (block, way, i, j, side, cid, part): those with a member of another part whose print doesn't tell
    them apart; with `sets`, links (a, b) that join what is near, fewer than the members. Prints (cid, size, bits) are gists, or
    sketches, with scope; a pair of sketches is looked at only where they first agree in a word."""
    exact, words = sets is not None, "scope" in prints.columns

    def each(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                block, way, i, j = (row.column(k)[0].as_py() for k in ("block", "way", "i", "j"))
                held = row.column("members").flatten()
                cids, parts, sides, sizes = (held.field(k).to_numpy(zero_copy_only=False) for k in ("cid", "part", "side", "size"))
                bits = held.field("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(cids), -1)
                shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in held.field("shingles")] if exact else []
                root, doubtful, links = np.unique(parts, return_inverse=True)[1], np.zeros(len(cids), bool), []
                for k in range(len(cids) - 1):
                    others = root[k + 1 :] != root[k]
                    if i != j:
                        others &= sides[k + 1 :] != sides[k]
                    others = np.flatnonzero(others) + k + 1
                    changed = bits[others] ^ bits[k]
                    fits = np.bitwise_count(changed).sum(axis=1, dtype=np.int64) <= allowed(sizes[others], sizes[k])
                    if words and len(others):
                        fits &= (changed == 0).argmax(axis=1) == way & 0xFFFFFFFF
                    others = others[fits]
                    if not exact:
                        doubtful[others] = True
                        doubtful[k] |= len(others) > 0
                        continue
                    for o in others:
                        if root[o] != root[k] and near(shingles[o], shingles[k]):
                            links.append((min(cids[k], cids[o]), max(cids[k], cids[o])))
                            root[root == root[o]] = root[k]
                if exact:
                    a, b = zip(*links, strict=True) if links else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                else:
                    kept = np.flatnonzero(doubtful)
                    same = {k: np.full(len(kept), v, t) for k, v, t in (("block", block, np.int64), ("way", way, np.int64), ("i", i, np.int32), ("j", j, np.int32))}
                    yield pa.RecordBatch.from_pydict({**same, "side": sides[kept].astype(np.int32), "cid": cids[kept], "part": parts[kept]})

    rows, fields = dealt.withColumn("scope", F.shiftright("way", 32).cast("int")) if words else dealt, ["cid", "part", "side", "size", "bits"]
    rows = rows.join(prints, ["cid", "scope"] if words else "cid")
    if exact:
        rows, fields = rows.join(sets, "cid"), [*fields, "shingles"]
    lists = rows.groupBy("block", "way", "i", "j").agg(F.collect_list(F.struct(*fields)).alias("members")).where(F.size("members") > 1)
    return lists.mapInArrow(each, "block long, way long, i int, j int, side int, cid long, part long" if not exact else "a long, b long")


def _with_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, sets: DataFrame | None) -> DataFrame:
    """`sets` and those of the members (cid) that it lacks."""
    new = members.distinct() if sets is None else members.distinct().join(sets.select("cid"), "cid", "left_anti")
    more = materialize(_sets(docs, classes.select("cid", "doc_id", "content").join(new, "cid", "left_semi")), "gram-sets")
    return more if sets is None else sets.unionByName(more)


def _star_pairs(members: DataFrame, tried: DataFrame | None) -> DataFrame:
    """At most one new pair a < b of each member (block, cid, weight, part): with the centre of one of its buckets, the member with
    the most company over all its buckets, where that is of another part."""
    centres = members.groupBy("block").agg(F.min(F.struct((-F.col("weight")).alias("order"), "cid", "part")).alias("centre"))
    met = members.select("block", "cid", "part").join(centres, "block").where("part <> centre.part")
    met = met.select("cid", "centre.order", F.least("cid", "centre.cid").alias("a"), F.greatest("cid", "centre.cid").alias("b"))
    if tried is not None:
        met = met.join(tried, ["a", "b"], "left_anti")
    return met.groupBy("cid").agg(F.min(F.struct("order", "a", "b")).alias("pair")).select("pair.a", "pair.b").distinct()


def _components(docs: DataFrame, prints: DataFrame, held: DataFrame, classes: DataFrame) -> DataFrame | None:
    """node, component of the classes (cid, doc_id, content, size, gist) that are linked to one with a smaller cid; `held` are
    members of shared buckets. Only texts of classes that gists don't tell apart from another are read again and moved;
    buckets that have become one part are left behind."""
    if held.isEmpty():
        return None
    held = held.join(held.groupBy("cid").agg(F.sum("n").alias("weight")), "cid").drop("n").withColumn("part", F.col("cid"))
    held = materialize(held, "gram-members")
    links = tried = parts = sets = None
    for _ in range(STAR_ROUNDS):
        pairs = materialize(_star_pairs(held, tried), "gram-stars")
        if pairs.isEmpty():
            break
        sifted = materialize(_sifted(pairs, classes), "gram-sifted")
        sets = _with_sets(docs, classes, sifted.select(F.explode(F.array("a", "b")).alias("cid")), sets)
        found = materialize(_verified(sifted, sets), "gram-links")
        links, tried = (found, pairs) if links is None else (links.unionByName(found), tried.unionByName(pairs))
        parts = stars(links)
        held = materialize(_apart_still(held, parts), "gram-members")
    # members that stay apart: most by their gists, of the others most by their sketches, the rest by counting
    doubtful = materialize(_apart(_dealt(held), classes.select("cid", "size", F.col("gist").alias("bits"))), "gram-doubtful")
    if doubtful.isEmpty():
        return parts
    sketches = materialize(_sketches(prints, doubtful.select("cid").distinct()), "gram-sketches")
    doubtful = materialize(_apart(doubtful, sketches), "gram-doubtful")
    more = _apart(doubtful, sketches, _with_sets(docs, classes, doubtful.select("cid"), sets))
    return stars(more if links is None else links.unionByName(more))


def join_near(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text): the smallest doc_id reachable over links between
    rows whose sets of three-word shingles have a Jaccard similarity of 0.9 or more.

    Words are lower-cased (A-Z); a text of fewer words is one shingle. Rows with equal sets are linked. A row without a word
    (null text included) has no shingle and is linked with nothing: its component is its own id. Ids may be null or repeat:
    rows are linked by their texts, and a component whose rows all lack an id has none. Other columns are ignored; an empty
    table gives an empty result.
    """
    prints = materialize(set_prints(docs).withColumn("rid", F.monotonically_increasing_id()), "gram-prints")
    full = prints.where("digest is not null")
    classes = full.groupBy("digest").agg(F.min(F.struct("rid", "doc_id", "content", "n_shingles", "gist")).alias("first"), F.min("doc_id").alias("least"))
    classes = materialize(classes.select("digest", F.col("first.rid").alias("cid"), "first.doc_id", "first.content", F.col("first.n_shingles").alias("size"), "first.gist", "least"), "gram-classes")
    key = F.sha2(F.col("rid").cast("string"), 256).alias("_key")
    copies = materialize(full.select("rid").join(classes.select(F.col("cid").alias("rid")), "rid", "left_anti").select(key), "gram-copies")
    keyed = _keyed(without(full.select("rid", "n_shingles", "scope", "own", "below", key), copies, "_key"))
    shared = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialize(keyed.join(shared, "block").select("block", "way", "cid", "size", "n"), "gram-buckets")
    parts = _components(docs, full, held, classes)
    root = classes.select("digest", "least", F.col("cid").alias("root"))
    if parts is not None:
        root = classes.join(parts, classes["cid"] == parts["node"], "left").select("digest", "least", F.coalesce("component", "cid").alias("root"))
    named = root.join(root.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "component_id")
    found = full.select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(prints.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
