"""Personal data in texts with very many matches, in odd tables, and beside context words."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from foliant.llm import pii


def spans_of(frame):
    return [[(x["kind"], x["start"], x["end"], x["score"]) for x in r["spans"]] for r in pii.with_spans(frame).select("spans").collect()]


def test_a_hundred_thousand_addresses_in_one_text(spark):
    parts = [f"user{i}@example{i % 7}.org" for i in range(100_000)]
    frame = spark.createDataFrame([(1, "x".join(["", *[f" {p} " for p in parts], ""]))], "doc_id long, text string")
    began = time.time()
    (found,) = spans_of(frame)
    text = frame.first()["text"]
    assert [text[a:b] for _, a, b, _ in found] == parts
    (clean,) = [r["text"] for r in pii.redact(frame).collect()]
    assert clean == "x".join(["", *[" <email> "] * len(parts), ""])
    assert time.time() - began < 60


def test_context_across_chunks_and_neighbouring_matches(spark):
    filler = "é" * 1_010
    texts = [
        f"{filler} ssn 123-45-6789", f"{filler}😀 123-45-6789 tax", f"ssn {'z' * 40} 123-45-6789", "123-45-6789", "SSN: 123-45-6789, 123-45-6780, 123-45-6781",
        f"{filler} card 4111 1111 1111 1111 and +49 30 1234567, mail a.b@c.org {filler} 1.2.3.4",
    ]
    found = spans_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [[x[0] for x in f] for f in found] == [["ssn"], ["ssn"], [], [], ["ssn"] * 3, ["email", "ip", "card", "phone"]]
    assert [texts[5][a:b] for _, a, b, _ in found[5]] == ["a.b@c.org", "1.2.3.4", "4111 1111 1111 1111", "+49 30 1234567"]
    assert found[0][0] == ("ssn", 1_015, 1_026, 0.6) and found[5][2][3] == 1.1


def test_overlapping_spans_become_one(spark):
    rows = [(1, "call +49 89 1.2.3.4 now"), (2, "a@1.2.3.4"), (3, None), (4, "nothing")]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean == {1: "call +49 89 <ip> now", 2: "<email>", 3: None, 4: "nothing"}


def test_odd_tables(spark):
    schema = "doc_id long, text string, spans string, _email int, _spans int, lang string"
    empty = spark.createDataFrame([], schema)
    assert pii.with_spans(empty).count() == 0 and pii.redact(empty).count() == 0
    rows = [(1, "a@b.c", "s", 1, 2, None)] * 2 + [(None, "a@b.c", None, None, None, "en"), (2, "", "s", 1, 2, "en"), (3, None, "s", 1, 2, "en")]
    frame = spark.createDataFrame(rows, schema)
    found = [(r["doc_id"], r["s"], r["lang"]) for r in pii.with_spans(frame).select("doc_id", pii.span_string(F.col("spans")).alias("s"), "lang").collect()]
    assert sorted(found, key=str) == sorted([(1, "email:0:5", None)] * 2 + [(None, "email:0:5", "en"), (2, "", "en"), (3, "", "en")], key=str)
    clean = pii.redact(frame)
    assert clean.columns == ["doc_id", "text", "spans", "lang"]
    assert sorted(str(r["text"]) for r in clean.collect()) == sorted(["<email>"] * 3 + ["", "None"])
