"""Best-fit packing of token sequences, bulk-synchronous.

Documents are taken in classes of falling length, each from over half a bound up to the bound. A superstep range-sorts
the class's documents together with slots of the gaps (a gap offers a slot of the bound for each time it holds it, and
one of its remainder) by falling size and sweeps the ranges side by side: a document takes the last slot before it that
no longer document has taken, which is its successor, the smallest slot left that holds it. Within a range that is a
stack; what a range leaves open is resolved across ranges by rank: free slots and unplaced documents are numbered like
brackets, and a document meets the slot of its own depth. Then the gaps are updated, sequences are opened for what
surely finds no room, and the next superstep begins; documents of half the bound follow once none of the class is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, join_small, materialize, new_path, running_offsets, slices, tables_made, whole_text

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: What a superstep leaves: a document with the sequence that it goes to, or null if it found none.
PLACED = "row long, length long, sequence long"
SWEPT = "part int, place long, is_doc boolean, row long, length long, sequence long, open boolean"
#: Documents and slots of one range of a sweep.
RANGE_ROWS = 65_536
#: The share of the gaps' room that a class is expected to fill before sequences are opened for it. With 1 or 0.9 the
#: sequences are as few as the tokens allow on the test tables; less takes fewer supersteps.
FILLED = 0.9


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut into pieces of `capacity` if longer.
    A null or empty text is one piece that holds end_id only."""
    from .tokens import word_tokenizer

    def cut(batches):
        tokenizer, end = word_tokenizer(tokenizer_path), end_id.to_bytes(4, "little")
        for b in slices(batches):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), tokenizer.ids(b.column(1).to_pylist()), strict=True):
                data = ids + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(cut, PIECES)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, sorted by falling size: matches documents with the slots before them, last in, first out. What stays open
    is numbered in order from 1: documents that no slot was left for, and slots that no document took."""
    names = [x.split()[0] for x in SWEPT.split(", ")]
    part, free, unplaced = 0, [], 0
    for b in batches:
        table = b.to_pydict()
        rows = []
        for part, is_doc, row, length, sequence in zip(table["part"], table["is_doc"], table["row"], table["size"], table["sequence"], strict=True):
            if not is_doc:
                free.append(sequence)
            elif free:
                rows.append((part, None, True, row, length, free.pop(), False))
            else:
                unplaced += 1
                rows.append((part, unplaced, True, row, length, None, True))
        yield _batch(rows, names)
    yield _batch([(part, i, False, None, None, s, True) for i, s in enumerate(free, 1)], names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def superstep(docs: DataFrame, slots: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """PLACED of every document of `docs` (row, length), given `slots` (sequence, size, room); `rows` are both together."""
    none = F.lit(None).cast("long")
    events = slots.select("size", F.lit(False).alias("is_doc"), "room", none.alias("row"), "sequence").unionByName(docs.select(F.col("length").alias("size"), F.lit(True).alias("is_doc"), none.alias("room"), "row", none.alias("sequence")))
    # of equal slots the one of the smallest gap comes last and so is taken first
    order = [F.desc("size"), F.asc("is_doc"), F.desc("room"), F.asc_nulls_first("sequence"), F.asc_nulls_first("row")]
    ranges = -(-rows // range_rows)
    ranged = events.repartitionByRange(ranges, *order) if ranges > 1 else events.coalesce(1)
    swept = ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).select("part", "size", "is_doc", "row", "sequence").mapInArrow(sweep, SWEPT)
    if ranges <= 1:
        return swept.where("is_doc").select("row", "length", "sequence")
    swept = materialize(swept, "swept")
    counts = swept.where("open").groupBy("part").agg(F.count_if("is_doc").alias("docs"), F.count_if(~F.col("is_doc")).alias("slots"))
    depths = running_offsets(counts.withColumn("net", F.col("slots") - F.col("docs")), [], ["part"], "net", "depth").select("part", "docs", "depth")  # one row a range
    ranked = join_small(swept.where("open"), depths, "part", "inner", ranges)
    level = F.when(F.col("is_doc"), F.col("depth") - F.col("place") + 1).otherwise(F.col("depth") - F.col("docs") + F.col("place"))
    # a depth has at most a document and a slot of each range, and they alternate
    before = Window.partitionBy("level").orderBy("part", F.desc("is_doc"))
    crossed = ranked.withColumn("level", level).withColumn("taken", F.lag("sequence").over(before)).where("is_doc").select("row", "length", F.col("taken").alias("sequence"))
    return swept.where("is_doc and not open").select("row", "length", "sequence").unionByName(crossed)


def _offers(gaps: DataFrame, rooms: dict[int, int], bound: int, wanted: int, stuck: bool) -> tuple[DataFrame, int]:
    """(slots: sequence, size, room; about how many) for `wanted` documents of over half `bound` up to it: those of the
    smallest gaps, up to a room at which there is a slot of the whole bound for each document. Of that room's gaps, where
    there are far more than needed, a share chosen by hash is offered, but all where the last sweep placed none."""
    last, full, offered, thin = 0, 0, 0, 1
    for room in sorted(r for r in rooms if 2 * r > bound):
        last, each = room, room // bound
        if each and full + each * rooms[room] >= wanted:
            thin = 1 if stuck else max(1, rooms[room] // (4 * -(-(wanted - full) // each)))
            offered += (each + 1) * rooms[room] // thin
            break
        full, offered = full + each * rooms[room], offered + (each + 1) * rooms[room]
    fit = gaps.where((2 * F.col("room") > bound) & ((F.col("room") < last) | (F.col("room") == last) & (F.pmod(F.xxhash64("sequence"), F.lit(thin)) == 0)))
    each, rest = F.floor(F.col("room") / bound).cast("int"), (F.col("room") % bound).cast("long")
    sizes = F.concat(F.array_repeat(F.lit(bound).cast("long"), each), F.when(2 * rest > bound, F.array(rest)).otherwise(F.array().cast("array<long>")))
    return fit.select("sequence", F.explode(sizes).alias("size"), "room"), offered


def _missing(rooms: dict[int, int], bound: int, docs: int, tokens: int, capacity: int, stuck: bool) -> int:
    """How many sequences to open for a class: none while the gaps offer a slot for each document, else as many as the
    tokens need beyond FILLED of the room; enough for all tokens where the gaps have no slot or the last sweep placed none."""
    slots = sum(n * (room // bound) for room, n in rooms.items())
    if slots >= docs:
        return 0
    if bound >= capacity:  # two of these never share a sequence
        return docs
    room = 0 if stuck or not slots else FILLED * sum(n * r for r, n in rooms.items() if 2 * r > bound)
    return max(0, int(-(-(tokens - room) // capacity)))


def _state(gaps: DataFrame, docs: DataFrame) -> tuple[dict[int, int], int, int]:
    """How many `gaps` there are of each room, and how many `docs` and of how many tokens; in one grouped sum, as it is asked for
    after every superstep."""
    none = F.lit(0).cast("long")
    counted = gaps.select("room", none.alias("length")).unionByName(docs.select(none.alias("room"), "length")).groupBy("room").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"))
    found = {r["room"]: (r["n"], r["tokens"]) for r in counted.collect()}
    left, tokens = found.pop(0, (0, 0))  # no gap has a room of 0
    return {room: n for room, (n, _) in found.items()}, left, tokens


def pack(pieces: DataFrame, capacity: int = 4096, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`pieces` with sequence_id and offset. Needs the column length (1 to capacity); carries all others.

    Rows have ids that are fixed when the pieces are written to the shared folder. Pieces of the whole capacity are
    sequences by themselves. The driver sees counts of lengths and of rooms only, at most `capacity` each. An empty table
    gives an empty result.
    """
    spark = pieces.sparkSession
    held = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    lengths = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= x <= capacity for x in lengths):
        raise ValueError("a piece is empty or longer than the capacity")
    base = new_path(spark, "placed")
    full = held.where(F.col("length") == capacity).select(F.col("_row").alias("row"), F.col("length").cast("long"), (-1 - F.col("_row")).alias("sequence"))
    full.write.parquet(f"{base}/step=0")
    gaps = spark.createDataFrame([], "sequence long, room long")
    rooms: dict[int, int] = {}
    opened, step, bound = 0, 0, capacity
    last: list[str] = []  # where the gaps are kept
    while bound:
        mine = {x: n for x, n in lengths.items() if bound < 2 * x and x <= bound and x < capacity}
        docs = held.where((F.col("length") * 2 > bound) & (F.col("length") <= bound) & (F.col("length") < capacity)).select(F.col("_row").alias("row"), F.col("length").cast("long"))
        left, tokens, stuck = sum(mine.values()), sum(x * n for x, n in mine.items()), False
        while left:
            if new := _missing(rooms, bound, left, tokens, capacity, stuck):
                gaps = gaps.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("sequence"), F.lit(capacity).cast("long").alias("room")))
                rooms[capacity] = rooms.get(capacity, 0) + new
                opened += new
            step, made = step + 1, len(tables_made(spark))
            slots, offered = _offers(gaps, rooms, bound, left, stuck)
            superstep(docs, slots, left + offered, range_rows).write.parquet(f"{base}/step={step}")
            placed = spark.read.schema(PLACED).parquet(f"{base}/step={step}")
            docs = placed.where("sequence is null").select("row", "length")
            taken = placed.where("sequence is not null").select("sequence", (-F.col("length")).alias("room"))
            gaps = materialize(gaps.unionByName(taken).groupBy("sequence").agg(F.sum("room").alias("room")).where("room > 0"), "gaps")
            before, (rooms, left, tokens) = left, _state(gaps, docs)
            *done, gaps_path = tables_made(spark)[made:]
            drop_tables(spark, [*last, *done])  # this step's sweeps and the gaps before it: what they led to is written
            last = [gaps_path]
            stuck = left == before
        bound //= 2
    rows = spark.read.schema(PLACED + ", step int").parquet(base).where("sequence is not null")
    inside = Window.partitionBy("sequence").orderBy("step", F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(F.col("row").alias("_row"), F.col("sequence").alias("sequence_id"), F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
    return held.join(rows, "_row").select(*[F.col(f"`{c}`") for c in pieces.columns], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """One row a piece of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text: empty. Null ids and repeated rows are packed like any other; other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity)
