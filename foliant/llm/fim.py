"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, end) over two buffers that never change: its text and the sentinels.
Cutting splits a descriptor, an arrangement permutes descriptors, the inverse permutation brings them back; text is
copied only where a result is spelled out, and hashes are fed descriptor by descriptor. Where a document is cut and how it
is arranged are columns, drawn from a hash of its id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_text

Piece = tuple[int, int, int]
SENTINELS = (b"<P>", b"<S>", b"<M>")
_SENTINEL_BUFFER = b"".join(SENTINELS)
_ENDS = [0, *np.cumsum([len(s) for s in SENTINELS]).tolist()]
TEXT, MARKS = 0, 1
_MARKS: list[Piece] = [(MARKS, a, b) for a, b in pairwise(_ENDS)]
#: The order of prefix, middle, suffix (0 to 2) and the three sentinels (3 to 5) in the output.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}


def cut(piece: Piece, places: Iterable[int]) -> list[Piece]:
    """The descriptor split at rising places within it, counted from its start; parts may be empty."""
    buffer, start, end = piece
    return [(buffer, a, b) for a, b in pairwise([start, *(start + p for p in places), end])]


def arrange(parts: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix with sentinels, in the order of the form."""
    held = [*parts, *_MARKS]
    return [held[k] for k in ARRANGEMENTS[form]]


def restore(pieces: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix of an arrangement, by the inverse permutation."""
    place = {k: at for at, k in enumerate(ARRANGEMENTS[form])}
    return [pieces[place[k]] for k in range(3)]


def arranged_pieces(output, form: str) -> list[Piece]:
    """Descriptors of an output's six parts: each sentinel of the form ends at the first place where it stands after the one
    before, since no text that is cut contains any."""
    data, places, at = bytes(output), [], 0
    for k in ARRANGEMENTS[form]:
        if k >= 3:
            at = data.index(SENTINELS[k - 3], at)
            places += [at, at := at + len(SENTINELS[k - 3])]
    return cut((TEXT, 0, len(data)), places[1:])


def spell(buffers, pieces: list[Piece]) -> bytes:
    return b"".join(buffers[b][start:end] for b, start, end in pieces)


def digest(buffers, pieces: list[Piece]) -> str:
    """SHA-256 of what the pieces spell, without spelling it."""
    found = hashlib.sha256()
    for b, start, end in pieces:
        found.update(buffers[b][start:end])
    return found.hexdigest()


def byte_places(data, places: Iterable[int]) -> list[int]:
    """Where the code points of these numbers begin in UTF-8 bytes; the number of all of them: the end."""
    leads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return [int(leads[p]) if p < len(leads) else len(data) for p in places]


def cuts(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> list[Column]:
    """form, n and the two cut places (first, second) of `docs` (doc_id, text), as columns."""
    text = whole_text()
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    n = F.length(text).cast("long")
    marked = F.lit(False)
    for s in SENTINELS:
        marked = marked | text.contains(s.decode())
    form = F.when((n == 0) | marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    return [form.alias("form"), n.alias("n"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second")]


def to_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output, output_sha256 of every row of `docs` (doc_id, text).

    plain (the text as it is) are empty texts, those with a sentinel in them and a tenth of the others; of the rest a fifth is
    spm. Null text counts as empty; a null id is drawn for like an empty one; repeated rows are kept; other columns are
    ignored; an empty table gives an empty result.
    """

    def each(batches):
        for b in slices(batches):
            outputs, digests = [], []
            for text, form, first, second in zip(b.column(4), *(b.column(k).to_pylist() for k in ("form", "first", "second")), strict=True):
                buffers = (memoryview(text.as_buffer()), memoryview(_SENTINEL_BUFFER))
                pieces: list[Piece] = [(TEXT, 0, len(buffers[0]))]
                if form != "plain":
                    pieces = arrange(cut(pieces[0], byte_places(buffers[0], (first, second))), form)
                outputs.append(spell(buffers, pieces))
                digests.append(digest(buffers, pieces))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "n", "form", "first", "second")), pa.array(outputs, pa.binary()), pa.array(digests, pa.string())], names=["doc_id", "n", "form", "first", "second", "output", "output_sha256"])

    form, n, first, second = cuts(docs, seed)
    rows = docs.select(F.col("doc_id").cast("long"), n, form, first, whole_text().cast("binary").alias("text"), second)
    made = rows.mapInArrow(each, "doc_id long, n long, form string, first long, second long, output binary, output_sha256 string")
    whole = F.col("form") == "plain"
    prefix, middle = F.when(~whole, F.col("first")), F.when(~whole, F.col("second") - F.col("first"))
    return made.select("doc_id", "n", "form", prefix.alias("prefix_chars"), middle.alias("middle_chars"), F.col("output").cast("string").alias("output"), "output_sha256")


def from_middle(made: DataFrame) -> DataFrame:
    """The columns of `made` but for output, with restored (the text) and restored_sha256, from output and form alone. A null
    output counts as empty, a null form as plain. An output that its form's sentinels are not in fails the job."""
    others = [c for c in made.columns if c not in ("output", "restored", "restored_sha256")]
    rows = made.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col("form"), F.lit("plain")).alias("_form"), F.coalesce(F.col("output"), F.lit("")).cast("binary").alias("_output"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])

    def each(batches):
        for b in slices(batches):
            texts, digests = [], []
            for output, form in zip(b.column(b.num_columns - 1), b.column(b.num_columns - 2).to_pylist(), strict=True):
                buffers = (memoryview(output.as_buffer()),)
                pieces = [(TEXT, 0, len(buffers[0]))] if form == "plain" else restore(arranged_pieces(buffers[0], form), form)
                texts.append(spell(buffers, pieces))
                digests.append(digest(buffers, pieces))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.binary()), pa.array(digests, pa.string())], names=[*b.schema.names[:-2], "restored", "restored_sha256"])

    return rows.mapInArrow(each, f"{kinds}, restored binary, restored_sha256 string").withColumn("restored", F.col("restored").cast("string"))
