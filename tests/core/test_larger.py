"""What shows only in larger tables, or in documents that few of the small tables hold."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from foliant.functions import batches
from foliant.operators import anonymize, documents, render, validate
from foliant.plans.registry import ORACLE_SQL, QUERIES
from foliant.sources import snapshots

from .test_queries import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_pages(tmp_path_factory):
    """The small tables with 1,001 pages, so that there are pages 998 and 999, and posts without a word of four letters."""
    at, con = tmp_path_factory.mktemp("many"), duckdb.connect()
    con.execute(f"COPY (SELECT range AS page_id, url, html FROM range(1001), (SELECT * FROM '{SF}/pages.parquet' LIMIT 1)) TO '{at}/pages.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CASE doc_id WHEN 3 THEN 'Re.' WHEN 4 THEN 'token = \"abc\" x' ELSE text END AS text) FROM '{SF}/documents.parquet') TO '{at}/documents.parquet'")
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{Path(SF)}/labels.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["convert", "convert_modules", "conversion_warnings", "conversion_census", "change_plan", "scrubbing_leaks"])
def test_query_is_its_sql_with_many_pages(spark, many_pages, name):
    at, con = many_pages
    got, want = QUERIES[name](spark, at), con.execute(ORACLE_SQL[name])
    columns, names = sorted(got.columns), [c[0] for c in want.description]
    order = [names.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_names_before_values_in_text_are_words(spark):
    docs = spark.createDataFrame([(1, 'token = "abc" x'), (2, '[et_pb_text token="abc"]x[/et_pb_text]')], "id long, post_content string")
    assert [tuple(r) for r in anonymize.personal_tokens(docs).collect()] == [(1, "word", "token")]


def test_rules_of_markup_move_nothing(spark):
    """Delimiters, levels and bodies are found in their document's own row: once, without a shuffle."""
    rows = spark.createDataFrame([(1, "<!-- wp:group --><!-- wp:quote --><p>x</p><!-- /wp:quote --><!-- wp:list -->"), (2, None)], "id long, markup string")
    found = validate.problems(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, "quote is no blockquote element"), (1, "unclosed group"), (1, "unclosed list")]


def test_python_gets_bounded_parts_of_a_batch():
    """However many rows a batch has: parts of few characters and rows, a long text alone, every row once and in order."""
    texts = ["x" * (1000 + 37 * (k % 50)) for k in range(4000)] + [None] * 1200 + ["y" * (batches.PART_BYTES + 1), "", "z"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    found = list(batches.parts(iter([rows, rows.slice(0, 0)]), 1))
    assert [i for b in found for i in b.column(0).to_pylist()] == list(range(len(texts)))
    sizes = [sum(len(x or "") for x in b.column(1).to_pylist()) for b in found]
    assert all(b.num_rows <= batches.PART_ROWS and (n <= batches.PART_BYTES or b.num_rows == 1) for b, n in zip(found, sizes, strict=True))


def test_the_node_table_is_no_part_of_a_kept_one(spark):
    plan = QUERIES["node_table"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "blocks" not in plan and "MapInArrow" in plan


def test_who_has_lost_already_rewrites_no_file(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/posts"
    snapshots.create(spark.createDataFrame([(k, f"body {k}") for k in range(20)], "id long, post_content string"), root)
    plan = snapshots.read(spark, root).selectExpr("id AS post_id", "'write' AS status", "md5(post_content) AS source_hash", "'new ' || post_content AS markup")
    snapshots.publish(plan, root, 1)
    monkeypatch.setattr(snapshots, "_commit", lambda *_: pytest.fail("its files were written"))
    with pytest.raises(snapshots.Lost):
        snapshots.publish(plan, root, 1)
    assert len(list((tmp_path / "posts" / "data").iterdir())) == 2 == len(list((tmp_path / "posts" / "commits").iterdir())) + 1


@pytest.fixture(scope="module")
def blank_texts(tmp_path_factory):
    """The small tables with texts of nothing, of blanks, and null, for every shape of a document."""
    at, con = tmp_path_factory.mktemp("blank"), duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE doc_id // 28 WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(10) WHEN 3 THEN NULL ELSE text END AS text) FROM '{SF}/documents.parquet') TO '{at}/documents.parquet'")
    con.execute(f"COPY (SELECT * FROM '{SF}/pages.parquet') TO '{at}/pages.parquet'")
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["convert_for_sites", "convert_modules", "module_warnings", "module_trees"])
def test_query_is_its_sql_with_blank_texts(spark, blank_texts, name):
    test_query_is_its_sql_with_many_pages(spark, blank_texts, name)


def shuffled_bytes(spark) -> int:
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_warnings_move_no_text(spark):
    """Nor does what is acknowledged; the documents are parsed once for all that is said of them, and not kept."""
    rng = random.Random(5)
    rows = [(i, f'[et_pb_counters][et_pb_counter percent="5"]a{rng.randbytes(9000).hex()}[et_pb_button button_text="b" /][/et_pb_counter]<b>{rng.randbytes(9000).hex()}</b>[/et_pb_counters][et_pb_gallery gallery_ids="1,2,x" /][et_pb_menu menu_id="7" /]') for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, post_content string")
    files = spark.createDataFrame([(1, "https://e.com/1.png", None, None)], "id long, url string, file string, guid string")
    before, nodes = shuffled_bytes(spark), documents.node_table(docs, loose=True)
    said = render.warnings(nodes, files)
    found = {(r["module"], r["message"]) for r in said.collect()}
    plan = said._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1
    assert {m for m, _ in found} == {"et_pb_counter", "et_pb_counters", "et_pb_gallery", "et_pb_menu"} and len(found) == 5
    assert ("et_pb_gallery", "1 of the 2 images of a gallery are not in the media library.") in found
    known = {tuple(r["acknowledged"]) for r in render.acknowledged_losses(nodes, files).collect()}
    assert known == {(0, 0, 1, 1)}
    assert 0 < shuffled_bytes(spark) - before < 200_000  # of 1.4 million characters of text


@pytest.mark.parametrize("name", ["module_warnings", "module_trees", "module_attributes"])
def test_queries_without_texts_keep_no_table(spark, name):
    assert "InMemoryRelation" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_rendering_moves_each_text_once(spark):
    body = f"[et_pb_section][et_pb_row][et_pb_column][et_pb_text]{'x' * 1000}[/et_pb_text][/et_pb_column][/et_pb_row][/et_pb_section][et_pb_code]{'y' * 1000}[/et_pb_code][et_pb_weird /]"
    nodes = documents.node_table(spark.createDataFrame([(1, body)], "id long, post_content string"), loose=True)
    held = str(render.drawn(nodes).collect())
    assert held.count("x" * 1000) == 1 and held.count("y" * 1000) == 2  # of code, and of the text in it, which is swallowed
    assert render.drawn(render.drawn(nodes)).collect() == render.drawn(nodes).collect()


def test_media_join_moves_no_rows_again(spark):
    """Nodes lie by document from their first shuffle on, and no join is by anything else."""
    docs = spark.createDataFrame([(1, '[et_pb_gallery gallery_ids="7,8" /][et_pb_text]a[/et_pb_text][et_pb_image src="https://e.com/7.png" /][et_pb_gallery gallery_ids="8" /]'), (2, "[et_pb_text]b[/et_pb_text]")], "id long, post_content string")
    files = spark.createDataFrame([(7, "https://e.com/7.png", None, None)], "id long, url string, file string, guid string")
    made = render.convert(docs, files)
    joins = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert joins and not any("node_id" in x for x in joins)
    markup = {r["id"]: r["markup"] for r in made.collect()}
    assert markup[1].count("wp-image-7") == 2 and markup[1].count("wp:gallery") == 4 and "wp-image-8" not in markup[1] and "<p>b</p>" in markup[2]
