"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distances, components.

Two uses share the parts. `link_fingerprints` links 64-bit fingerprints of three-word shingles at two or fewer
differing bits, exactly. `near_duplicate_classes`, for the pipeline, groups texts whose sets of five-word shingles have
a Jaccard similarity of 0.8 or more. Such texts differ in up to 15 bits of a hundred, so that blocks of 24 fixed bits
would have to be 355 to miss one in a thousand. Of many SimHash bits those with the largest majorities seldom differ,
so a block is the surest bit of 512 and that of 512 others: which they are, and whether they are set. Hamming distances
sift the members of a bucket and the pairs, and links are confirmed on the sets themselves where the distance leaves a doubt.
Documents with one fingerprint are one class throughout, so copies are never paired.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialize, maybe_in, slices, tables_made, whole_text, without
from .graph import stars

SEED = 42
#: For each byte value, its bits as eight counters of eight bits each.
_LANES = np.array([sum(((v >> i) & 1) << 8 * i for i in range(8)) for v in range(256)], np.uint64)
#: Fixed values of the splitmix64 mixer.
_GAMMA, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SALTS = np.arange(1, 9, dtype=np.uint64) * _GAMMA
CHUNK = 8_192

#: Blocks of 16 bits: fingerprints that differ in at most two bits agree in two of four.
BLOCKS, CHOSEN, BLOCK_BITS, DISTANCE = 4, 2, 16, 2
#: Fingerprints of a bucket whose pairs are checked; larger buckets take the exact way of `_by_midpoints`.
BUCKET = 48

FIVE_BITS = 2_048
#: A block is the surest of GROUP SimHash bits, twice. A simulation of normal sums has sets of one size at 0.8 (a cosine of
#: 8 / 9) agree in one with a probability of 0.349, in the block with 0.122: such a pair shares none of the WAYS blocks with
#: (1 - 0.122) ** 80 = 3e-5, one at 0.85 with 2e-7. Sets without a shingle in common share a block of 20 bits by chance.
GROUP, WAYS = 512, 80
#: Members of a bucket of up to SIEVED stay if another's first 128 bits differ from theirs in at most SIEVE: at 0.8 some 19
#: do, with a deviation of 4.1; of texts that have nothing in common 64, with one of 5.7.
SIEVE, SIEVED = 40, 128
#: Two texts are near at a Jaccard similarity of NEAR[0] / NEAR[1].
NEAR = (4, 5)
#: Hamming distances of 2,048 bits tell similarities apart to about 0.02 a standard deviation: pairs that DEVIATIONS of them
#: put below NEAR are dropped (three in a million of those at NEAR), pairs that they put above it are linked, and sets are
#: compared for those between. Sets of under SIFTED shingles, for which the bits follow the angle less well, are always
#: compared.
DEVIATIONS, SIFTED = 4.5, 100
#: Members of a bucket, and shingles of their sets, that one chunk holds; members of large buckets meet chunk by chunk.
MEMBERS, SHINGLES = 512, 1 << 20
#: Rounds in which a text is held against one other before the members of a bucket that stay apart are compared.
STAR_ROUNDS = 3


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (n, words) of uint64 have each of the 64 * words bits set."""
    width = hashes.shape[1] * 8
    total = np.zeros((width, 8), np.int64)
    data = np.ascontiguousarray(hashes).view(np.uint8)
    for i in range(0, len(data), 255):  # an eight-bit counter holds 255
        total += np.add.reduce(_LANES[data[i : i + 255]], axis=0).view(np.uint8).reshape(width, 8)
    return total.ravel()


def majority(counts: np.ndarray, n: int) -> bytes:
    """Bits set in over half of n, the first in the lowest bit of the first byte."""
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits, unsigned: the majority of the XXH64 values of the text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(found) - words + 1)
    spans = list(zip(starts[:k].tolist(), ends[-k:].tolist(), strict=True))
    counts = np.zeros(64, np.int64)
    for i in range(0, k, CHUNK):
        part = spans[i : i + CHUNK]
        counts += bit_counts(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in part), np.uint64, len(part)).reshape(-1, 1))
    return int.from_bytes(majority(counts, k), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (long, the same bits) of every row of `docs` (doc_id, text); null text counts as empty."""

    def each(batches):
        for b in slices(batches):
            found = np.array([fingerprint(x.as_py(), words) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(each, "doc_id long, fp long")


def _by_blocks(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links a, b of verified pairs; fingerprints of large buckets) from distinct fingerprints fp."""
    masks = [sum(((1 << BLOCK_BITS) - 1) << BLOCK_BITS * i for i in chosen) for chosen in combinations(range(BLOCKS), CHOSEN)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("way", "block"))
    sizes = keyed.groupBy("way", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialize(keyed.join(sizes, ["way", "block"]), "blocks")
    lists = held.where(F.col("n") <= BUCKET).groupBy("way", "block").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct(), held.where(F.col("n") > BUCKET).select("fp").distinct()


def _by_midpoints(fps: DataFrame) -> DataFrame:
    """Links with the components of all pairs at two or fewer differing bits, in a number that grows with the
    fingerprints and not with their pairs: such a pair has a midpoint, one bit or none from either, and all
    fingerprints around a midpoint are that close to each other, so each is linked to the least of them."""
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    reached = fps.select("fp", F.explode(around).alias("mid"))
    least = reached.groupBy("mid").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return reached.join(least, "mid").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of `prints` (doc_id, fp): the smallest doc_id reachable over links of two or
    fewer differing bits, itself included (null where no row of the component has an id). An empty table gives an
    empty result; repeated rows are kept."""
    prints = materialize(prints.select("doc_id", "fp"), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links, crowded = _by_blocks(classes)
    found = stars(links.unionByName(_by_midpoints(crowded)))
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# Near-duplicates of five-word shingles, for the pipeline.


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: A Hadamard matrix: with signs before it, it turns the sums of SIDE * SIDE hyperplanes into those of as many others.
SIDE = 32
_TURN = np.array([[(-1) ** (i & j).bit_count() for j in range(SIDE)] for i in range(SIDE)], np.float32)


def _signs(turns: int, width: int) -> np.ndarray:
    """Fixed signs, the same in every process."""
    drawn = _mix(np.arange(1, turns * width // 64 + 1, dtype=np.uint64) * _GAMMA)
    return (1 - 2.0 * np.unpackbits(drawn.view(np.uint8), bitorder="little")).astype(np.float32).reshape(turns, width)


_WAY_SIGNS = _signs(FIVE_BITS // SIDE**2 + WAYS, SIDE**2)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Distinct shingles of `words` words (the whole text, if shorter), as sorted 64-bit hashes."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    n = len(found)
    hashes = np.fromiter(map(xxh64_intdigest, found), np.uint64, n)
    words = max(1, min(words, n))
    shingles = np.zeros(max(0, n - words + 1), np.uint64)
    for i in range(words):
        shingles = _mix(shingles + _SALTS[i] + hashes[i : n - words + 1 + i])
    return np.unique(shingles)


def _turned(sums: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of SIDE * SIDE sums in other hyperplanes. All numbers are integers below 2^24, so the result is exact."""
    for _ in range(2):
        sums = (sums * signs).reshape(-1, SIDE) @ _TURN
        sums, signs = sums.reshape(-1, SIDE, SIDE).transpose(0, 2, 1).reshape(-1, SIDE**2), np.float32(1)
    return sums


def plane_sums(shingles: np.ndarray, bits: int = FIVE_BITS) -> np.ndarray:
    """What SimHash takes the signs of: for each of `bits` hyperplanes the sum of the set's shingles, each +1 or -1; in rows."""
    lanes = np.arange(1, bits // 64 + 1, dtype=np.uint64) * _GAMMA
    counts = np.zeros(bits, np.int64)
    for i in range(0, len(shingles), 2 * 255):
        counts += bit_counts(_mix(shingles[i : i + 2 * 255, None] + lanes))
    sums = 2.0 * counts - len(shingles)
    most = np.abs(sums).max()
    return (np.rint(sums * (2**14 / most)) if most > 2**14 else sums).astype(np.float32).reshape(-1, SIDE**2)


def wide_fingerprint(sums: np.ndarray) -> bytes:
    """SimHash of a set, each shingle once, by its sums. They are turned first: sums of a few shingles are often zero, turned
    ones are not, so that the bits of small sets follow the angle too."""
    return np.packbits(_turned(sums, _WAY_SIGNS[: len(sums)]) > 0, bitorder="little").tobytes()


def bit_blocks(sums: np.ndarray) -> np.ndarray:
    """WAYS block keys of a set by its SimHash sums: the way, and of each of two groups of GROUP bits the one with the largest
    majority and its value."""
    signs = _WAY_SIGNS[len(sums) :]
    turned = _turned(sums[np.arange(WAYS) % len(sums)], signs).reshape(2 * WAYS, GROUP)
    surest = np.abs(turned).argmax(axis=1)
    found = (2 * surest + (turned[np.arange(2 * WAYS), surest] > 0)).reshape(WAYS, 2)
    return (np.arange(WAYS) * 2 * GROUP + found[:, 0]) * 2 * GROUP + found[:, 1]


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, content (SHA-256 of the text), and of its five-word shingles: how many, their SimHash, its first 128 bits as low
    and high, and their blocks, four bytes each, in one string, `keys`."""

    def each(batches):
        for b in slices(batches):
            sets = [shingle_set(x.as_py()) for x in b.column(2)]
            prints, found = [], []
            for x in sets:
                sums = plane_sums(x)
                prints.append(wide_fingerprint(sums))
                found.append(bit_blocks(sums))
            low, high = (pa.array([int.from_bytes(x[k : k + 8], "little", signed=True) for x in prints], pa.int64()) for k in (0, 8))
            keys = pa.array([x.astype(np.uint32).tobytes() for x in found], pa.binary())
            columns = {"doc_id": b.column(0), "content": b.column(1), "size": pa.array(map(len, sets), pa.int64()), "fives": pa.array(prints, pa.binary())}
            yield pa.RecordBatch.from_pydict({**columns, "low": low, "high": high, "keys": keys})

    rows = docs.select(F.col("doc_id").cast("long"), F.sha2(whole_text(), 256).alias("content"), whole_text().alias("text"))
    return rows.mapInArrow(each, "doc_id long, content string, size long, fives binary, low long, high long, keys binary")


def verdicts(distance: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(surely near, surely not) of pairs with so many differing bits and sets of so many shingles: the similarity that the
    angle tells, DEVIATIONS below and above the distance."""
    root = np.sqrt(one.astype(float) * two)

    def similarity(bits: np.ndarray) -> np.ndarray:
        both = root * np.cos(np.pi * np.clip(bits, 0, FIVE_BITS / 2) / FIVE_BITS)
        return both / np.maximum(one + two - both, 1e-9)

    share = np.clip(distance / FIVE_BITS, 0.01, 0.5)
    off = DEVIATIONS * np.sqrt(FIVE_BITS * share * (1 - share))
    large = np.minimum(one, two) >= SIFTED
    return large & (similarity(distance + off) >= NEAR[0] / NEAR[1]), large & (similarity(distance - off) < NEAR[0] / NEAR[1])


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, shingles (the upper four bytes of each, in order) of the classes `wanted` (cid, doc_id, content): one text of each
    moves, but for repeated rows."""

    def each(batches):
        for b in slices(batches):
            sets = ((shingle_set(x.as_py()) >> np.uint64(32)).astype(np.uint32).tobytes() for x in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["cid", "shingles"])

    def keyed(rows: DataFrame, content) -> DataFrame:
        return rows.withColumn("_key", F.sha2(F.concat_ws(":", content, F.col("doc_id").cast("string")), 256))

    wanted = keyed(wanted, F.col("content")).select("cid", "_key")
    texts = maybe_in(keyed(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")), F.sha2("text", 256)), wanted, "_key")
    return texts.join(wanted, "_key").groupBy("cid").agg(F.first("text").alias("text")).mapInArrow(each, "cid long, shingles binary")


def _sifted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, sure of the pairs a, b that aren't surely apart by their Hamming distance; sure ones needn't be confirmed."""

    def each(batches):
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, FIVE_BITS // 64) for k in (2, 3))
            near, far = verdicts(np.bitwise_count(one ^ two).sum(axis=1), *(b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near)], names=["a", "b", "sure"]).filter(pa.array(~far))

    side = lambda k: classes.select(F.col("cid").alias(k), F.col("fives").alias(f"{k}_fives"), F.col("size").alias(f"{k}_size"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    return held.select("a", "b", "a_fives", "b_fives", "a_size", "b_size").mapInArrow(each, "a long, b long, sure boolean")


def _near(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sets, in order, have a similarity of NEAR or more."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if not len(large):
        return True
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return NEAR[1] * both >= NEAR[0] * (len(one) + len(two) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b (with sure) whose sets are near, by counting where that isn't sure."""

    def each(batches):
        for b in batches:
            near = [_near(*(np.frombuffer(v.as_buffer(), np.uint32) for v in xy)) for xy in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    held = pairs.where("not sure").join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("two")), "b")
    return pairs.where("sure").select("a", "b").unionByName(held.select("a", "b", "one", "two").mapInArrow(each, "a long, b long"))


def _buckets(classes: DataFrame) -> DataFrame:
    """block, way, cid, size, n of the members of buckets that are to be looked at: n members of a block that more than one has.
    Of small buckets only those stay that another member is close to by the first bits of the fingerprint, so what meets by
    chance goes no further; large ones stay whole."""
    keyed = classes.select("cid", "size", "low", "high", "keys", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))).alias("way"))
    keyed = keyed.select("cid", "size", "low", "high", "way", F.xxhash64(F.expr("substring(keys, 4 * way + 1, 4)")).alias("block"))
    met = materialize(keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("block"))).where("n > 1"), "near-blocks")
    lists = met.where(F.col("n") <= SIEVED).groupBy("block", "way").agg(F.collect_list(F.struct("cid", "size", "low", "high")).alias("members"))
    apart = lambda a, b: F.bit_count(a["low"].bitwiseXOR(b["low"])) + F.bit_count(a["high"].bitwiseXOR(b["high"]))
    close = lists.withColumn("members", F.filter("members", lambda a: F.exists("members", lambda b: (a["cid"] != b["cid"]) & (apart(a, b) <= SIEVE))))
    close = close.select("block", "way", F.explode("members").alias("m"), F.size("members").cast("long").alias("n"))
    columns = ["block", "way", "cid", "size", "n"]
    return materialize(close.select("block", "way", "m.cid", "m.size", "n").unionByName(met.where(F.col("n") > SIEVED).select(*columns)), "near-buckets")


def _in_parts(held: DataFrame, parts: DataFrame) -> DataFrame:
    """The members of buckets (cid and more) with part: the component of `parts`, or the member itself."""
    return held.join(parts, held["cid"] == parts["node"], "left").withColumn("part", F.coalesce("component", "cid")).drop("node", "component")


def _apart_still(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The members of buckets that hold several parts, with their part."""
    now = _in_parts(members.drop("part"), parts)
    several = now.groupBy("block").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first <> last").select("block")
    return now.join(several, "block", "left_semi")


def _star_pairs(members: DataFrame, tried: DataFrame | None) -> DataFrame:
    """At most one new pair a < b of each member (block, cid, weight, part): with the centre of one of its buckets, where
    that is of another part. The centre of a bucket has the most company over all its buckets: of edited copies, the least edited."""
    centres = members.groupBy("block").agg(F.min(F.struct((-F.col("weight")).alias("order"), "cid", "part")).alias("centre"))
    met = members.select("block", "cid", "part").join(centres, "block").where("part <> centre.part")
    met = met.select("cid", "centre.order", F.least("cid", "centre.cid").alias("a"), F.greatest("cid", "centre.cid").alias("b")).distinct()
    if tried is not None:
        met = met.join(tried, ["a", "b"], "left_anti")
    return met.groupBy("cid").agg(F.min(F.struct("order", "a", "b")).alias("pair")).select("pair.a", "pair.b").distinct()


def _dealt(members: DataFrame) -> DataFrame:
    """block, way, i, j, side, cid, part of the members (block, way, cid, size, part) of buckets of several parts: those with
    one block, i and j are to be compared, where i < j only between the two sides. A small bucket is one chunk. In a large
    one the part with the most members is cut into chunks apart from the rest: its chunks meet those of the rest, not each
    other, so that a large group and the few texts that did not join it cost no more than their sizes."""
    need = lambda n, held: F.greatest(F.ceil(n / MEMBERS), F.ceil(held / SHINGLES), F.lit(1)).cast("int")
    by_part = members.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"))
    mixed = by_part.groupBy("block").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("held").alias("held"), F.max(F.struct("n", "held", "part")).alias("main")).where("parts > 1")
    mixed = mixed.select("block", F.col("main.part").alias("most"), (need(F.col("n"), F.col("held")) == 1).alias("small"), need(F.col("main.n"), F.col("main.held")).alias("mains"), need(F.col("n") - F.col("main.n"), F.col("held") - F.col("main.held")).alias("rests"))
    drawn, within = F.xxhash64("cid"), F.col("part") == F.col("most")
    side = F.when(F.col("small"), 0).when(within, F.pmod(drawn, "mains")).otherwise(F.col("mains") + F.pmod(drawn, "rests")).cast("int")
    rows = members.join(mixed, "block").withColumn("side", side)
    first = F.when(within & ~F.col("small"), F.col("mains")).otherwise(F.lit(0))
    last = F.when(F.col("small"), F.lit(0)).otherwise(F.col("mains") + F.col("rests") - 1)
    met = F.transform(F.sequence(first, last), lambda k: F.struct(F.least(k, "side").alias("i"), F.greatest(k, "side").alias("j")))
    return rows.select("block", "way", "side", "cid", "part", F.explode(met).alias("ij")).select("block", "way", "ij.i", "ij.j", "side", "cid", "part")


def _within_buckets(dealt: DataFrame, classes: DataFrame, sets: DataFrame | None) -> DataFrame:
    """Of the members `dealt`, without `sets` (as dealt): those with a member of another part that isn't surely apart from
    them by its Hamming distance. With sets (a, b): links that join what is near, confirmed by counting where the distance
    doesn't tell; members that links of the same task have joined are not compared again, so links are no more than members.
    A pair is looked at only in the first way in which it shares a block."""
    exact = sets is not None

    def each(batches):
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                members = row["members"]
                cids, parts, sides, sizes = (np.array([m[k] for m in members], np.int64) for k in ("cid", "part", "side", "size"))
                bits = np.frombuffer(b"".join(m["fives"] for m in members), np.uint64).reshape(len(members), -1)
                before = np.frombuffer(b"".join(m["keys"] for m in members), np.uint32).reshape(len(members), row["way"])
                shingles = [np.frombuffer(m["shingles"], np.uint32) for m in members] if exact else []
                root = np.unique(parts, return_inverse=True)[1]
                open_, links = np.zeros(len(members), bool), []
                for k in range(len(members) - 1):
                    others = root[k + 1 :] != root[k]
                    if row["i"] != row["j"]:
                        others &= sides[k + 1 :] != sides[k]
                    others = np.flatnonzero(others) + k + 1
                    others = others[~(before[others] == before[k]).any(axis=1)]
                    if not len(others):
                        continue
                    distance = np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1)
                    near, far = verdicts(distance, sizes[others], np.full(len(others), sizes[k]))
                    if not exact:
                        open_[others[~far]] = True
                        open_[k] |= not far.all()
                        continue
                    for at in np.argsort(distance, kind="stable"):
                        o = others[at]
                        if not far[at] and root[o] != root[k] and (near[at] or _near(shingles[o], shingles[k])):
                            links.append((int(cids[k]), int(cids[o])))
                            root[root == root[o]] = root[k]
                if exact:
                    yield pa.RecordBatch.from_pylist([{"a": min(x), "b": max(x)} for x in links], pa.schema([("a", pa.int64()), ("b", pa.int64())]))
                else:
                    kept = np.flatnonzero(open_)
                    same = {k: np.full(len(kept), row[k], t) for k, t in (("block", np.int64), ("way", np.int32), ("i", np.int32), ("j", np.int32))}
                    yield pa.RecordBatch.from_pydict({**same, "side": sides[kept].astype(np.int32), "cid": cids[kept], "part": parts[kept]})

    rows = dealt.join(classes.select("cid", "size", "fives", "keys"), "cid").withColumn("keys", F.expr("substring(keys, 1, 4 * way)"))
    fields = ["cid", "part", "side", "size", "fives", "keys"]
    if exact:
        rows, fields = rows.join(sets, "cid"), [*fields, "shingles"]
    lists = rows.groupBy("block", "way", "i", "j").agg(F.collect_list(F.struct(*fields)).alias("members")).where(F.size("members") > 1)
    return lists.mapInArrow(each, "block long, way int, i int, j int, side int, cid long, part long" if not exact else "a long, b long")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, content, root of every row of `docs`: rows with one root are one group of near-duplicates.

    In each of STAR_ROUNDS rounds a text is held against one other, the centre of one of its buckets, and the components of
    the links so far are one part from then on; so a group of near copies costs as many pairs as members. Only members of
    a bucket that stay in different parts are then compared with each other, within tasks that return links, not pairs.
    """
    prints = materialize(wide_fingerprints(docs), "wide-prints")
    classes = prints.groupBy("fives").agg(F.min(F.struct("content", "doc_id")).alias("first"), *[F.first(k).alias(k) for k in ("size", "low", "high", "keys")])
    classes = materialize(classes.select("fives", "first.content", "first.doc_id", "size", "low", "high", "keys").withColumn("cid", F.monotonically_increasing_id()), "wide-classes")
    spark, before = docs.sparkSession, len(tables_made(docs.sparkSession))
    held = _buckets(classes)
    held = held.join(held.groupBy("cid").agg(F.sum("n").alias("weight")), "cid").drop("n").withColumn("part", F.col("cid"))
    held = materialize(held, "near-members")
    *done, members = tables_made(spark)[before:]
    drop_tables(spark, done)
    sets = materialize(_shingle_sets(docs, classes.join(held, "cid", "left_semi").select("cid", "doc_id", "content")), "shingle-sets")
    links = tried = None
    for _ in range(STAR_ROUNDS):
        pairs = materialize(_star_pairs(held, tried), "star-pairs")
        if pairs.isEmpty():
            break
        found = materialize(_confirmed(materialize(_sifted(pairs, classes), "star-sifted"), sets), "star-links")
        links, tried = (found, pairs) if links is None else (links.unionByName(found), tried.unionByName(pairs))
        # written once, so that no plan to come holds these joins; those before it have served
        held = materialize(_apart_still(held, stars(links)), "near-members")
        drop_tables(spark, [members])
        members = tables_made(spark)[-1]
    if links is not None:
        doubtful = materialize(_within_buckets(_dealt(held), classes, None), "doubtful-members")
        parts = stars(links.unionByName(_within_buckets(doubtful, classes, sets)))
        roots = classes.join(parts, classes["cid"] == parts["node"], "left").select("fives", F.coalesce("component", "cid").alias("root"))
    else:
        roots = classes.select("fives", F.col("cid").alias("root"))
    return prints.join(roots, "fives").select("doc_id", "content", "root")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: of each group of near-duplicates the one with the smallest doc_id (null last; of
    equal ids the one with the least SHA-256 of its text), once.

    Null texts count as empty, and all texts without a word are one group; texts of fewer than five words are compared
    whole. All columns of docs are returned as they are; an empty table gives an empty result.
    """
    classes = materialize(near_duplicate_classes(docs), "near-classes")
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("stays"))
    stays = first.select("stays.doc_id", "stays.content")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    key = lambda content: F.sha2(F.concat_ws(":", content, F.col("doc_id").cast("long").cast("string")), 256).alias("_key")
    goes = classes.join(stays.select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")), same, "left_anti").select(key("content")).distinct()
    kept = without(docs.withColumn("_key", key(F.sha2(whole_text(), 256))), materialize(goes, "near-gone"), "_key")
    # a row that stays may stand there more than once
    repeated = not classes.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return (kept.dropDuplicates(["_key"]) if repeated else kept).drop("_key")
