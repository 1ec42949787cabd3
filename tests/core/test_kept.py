"""Published versions, kept counts and listings, sites, and stored snapshots on small tables of our own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import inventory, listing, writeplan
from foliant.operators.inventory import ScanRequest
from foliant.sources import attachments, sites, snapshots

POST = "id long, post_title string, post_type string, post_status string, post_date date, post_content string"
PLAN = "post_id long, status string, source_hash string, markup string"


@pytest.fixture
def root(spark, tmp_path):
    path = f"file://{tmp_path}/posts"
    rows = [(i, f"t{i}", "post", "publish", None, f"body {i}") for i in range(40)] + [(None, None, None, None, None, "no id")]
    docs = spark.createDataFrame(rows, POST).repartitionByRange(4, "id")
    assert snapshots.create(docs, path) == 1
    return path


def plan(spark, root, ids, text, version=None):
    now = snapshots.read(spark, root, version).where(F.col("id").isin(*ids)).select("id", F.md5("post_content").alias("h"))
    return spark.createDataFrame([(r["id"], "write", r["h"], text) for r in now.collect()], PLAN)


def outcomes(rows):
    return {r["post_id"]: r["outcome"] for r in rows.collect()}


def test_only_touched_files_are_rewritten(spark, root):
    before = set(snapshots.files(spark, root, 1))
    assert len(before) == 4
    assert outcomes(snapshots.publish(plan(spark, root, [3], "new"), root)) == {3: "written"}
    after = set(snapshots.files(spark, root, 2))
    assert len(before & after) == 3 and snapshots.latest(spark, root) == 2
    now = {r["id"]: r["post_content"] for r in snapshots.read(spark, root).collect()}
    assert now == {i: f"body {i}" for i in range(40)} | {3: "new", None: "no id"}
    assert {r["post_content"] for r in snapshots.read(spark, root, 1).where("id = 3").collect()} == {"body 3"}  # readers of a version keep it
    assert snapshots.vacuum(spark, root) == 0 and snapshots.read(spark, root).count() == 41
    snapshots.publish(plan(spark, root, range(40), "all"), root)
    assert snapshots.vacuum(spark, root) == 2 and snapshots.latest(spark, root) == 3 and snapshots.read(spark, root).where("post_content = 'all'").count() == 40


def test_of_two_publishers_one_loses_and_nothing_of_it_stays(spark, root):
    one, two = plan(spark, root, [1, 2], "one"), plan(spark, root, [2, 30], "two")
    snapshots.publish(one, root, 1)
    held = {p: {s.getPath().getName() for s in fs.listStatus(path)} for p in ("data", "manifests", "commits") for fs, path in [snapshots._path(spark, f"{root}/{p}")]}
    with pytest.raises(snapshots.Lost):
        snapshots.publish(two, root, 1)
    assert held == {p: {s.getPath().getName() for s in fs.listStatus(path)} for p in held for fs, path in [snapshots._path(spark, f"{root}/{p}")]}
    assert snapshots.latest(spark, root) == 2 and snapshots.read(spark, root).where("post_content = 'two'").count() == 0
    assert outcomes(snapshots.publish(two, root)) == {2: "stale", 30: "written"}  # read again, what was edited is refused by row
    assert {r["id"]: r["post_content"] for r in snapshots.read(spark, root).where("id in (1, 2, 30)").collect()} == {1: "one", 2: "one", 30: "two"}


def test_what_a_publisher_refuses(spark, root):
    right = {r["id"]: r["h"] for r in snapshots.read(spark, root).select("id", F.md5("post_content").alias("h")).collect()}
    rows = [(1, "refuse", right[1], "x"), (2, "write", "other", "x"), (3, "write", right[3], "x"), (3, "write", right[3], "y"), (99, "write", "h", "x"), (4, "write", right[4], "body 4"), (5, "write", None, "x"), (6, None, right[6], "x"), (None, "write", right[None], "x")]
    got = snapshots.publish(spark.createDataFrame(rows, PLAN), root)
    assert sorted((r["post_id"] is None, r["post_id"], r["outcome"]) for r in got.where("post_id is not null").collect()) == [(False, 1, "refused"), (False, 2, "stale"), (False, 3, "ambiguous"), (False, 3, "ambiguous"), (False, 4, "unchanged"), (False, 5, "stale"), (False, 6, "refused"), (False, 99, "gone")]
    assert snapshots.latest(spark, root) == 1  # nothing to write, no version
    assert snapshots.publish(spark.createDataFrame([], PLAN), root).count() == 0


def random_posts(spark, rng, ids):
    bodies = ["", None, "x", "[et_pb_text]", "<!-- wp:divi/a -->", "<!-- wp:divi/a -->[et_pb_text]"]
    return spark.createDataFrame([(i, "t", rng.choice(["post", "page", "other", None]), rng.choice(["publish", "draft", "trash", None]), None, rng.choice(bodies)) for i in ids], POST)


def test_deltas_keep_counts_as_a_full_count_would(spark):
    rng = random.Random(3)
    meta = spark.createDataFrame([(i, i % 20, "_d2g_divi_backup", "b") for i in range(30)], "meta_id long, post_id long, meta_key string, meta_value string")
    docs = random_posts(spark, rng, range(60))
    counts = listing.count_table(docs, meta)
    for k in range(3):
        ids = rng.sample(range(60), 15)
        before, after = docs.where(F.col("id").isin(*ids)), random_posts(spark, rng, [*ids[2:], 100 + k])  # two posts go, one comes
        counts = listing.moved(counts, listing.count_deltas(before, after, meta))
        docs = spark.createDataFrame(docs.where(~F.col("id").isin(*ids)).unionByName(after).collect(), POST)
        full = {r["filter"]: tuple(r[c] for c in listing.COUNTS) for r in listing.count_table(docs, meta).collect()}
        assert {r["filter"]: tuple(r[c] for c in listing.COUNTS) for r in counts.collect()} == full
    one = inventory.counts(docs, meta).first()
    assert (one["total_items"], one["newer_count"]) == full["all"]


TITLES = ["Äpfel", "apfel", "Banane", "banane", "BANANE", "Zoo", "zoo", None, "", "éclair", "Eclair", "-x", "10", "9"]


def test_titles_sort_without_case_and_accents(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "id long, post_title string")
    got = [r["post_title"] for r in rows.orderBy(*ScanRequest().sort()).collect()]
    assert got == [None, "", "-x", "10", "9", "Äpfel", "apfel", "Banane", "banane", "BANANE", "éclair", "Eclair", "Zoo", "zoo"]


@pytest.mark.parametrize("orderby,order", [("title", "asc"), ("title", "desc"), ("date", "desc"), ("status", "asc")])
def test_a_page_reads_its_range_only(spark, tmp_path, orderby, order):
    rng, path = random.Random(1), f"file://{tmp_path}/pages"
    titles = [f"{rng.choice('aAbBcC')}{rng.randrange(60)}" for _ in range(1000)] + [None] * 20
    rows = spark.createDataFrame([(i, t, None if i % 9 == 0 else i % 50) for i, t in enumerate(titles)], "id long, post_title string, d int").select("id", "post_title", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("post_date"), F.when(F.col("d") > 25, "a").otherwise("B").alias("post_status"))
    request = lambda n: ScanRequest(orderby=orderby, order=order, per_page=20, paged=n)
    listing.build_pages(rows, request(1), path, range_rows=100)
    whole = [r["id"] for r in rows.orderBy(*request(1).sort()).collect()]
    ranges = spark.read.parquet(f"{path}/counts").count()
    assert ranges > 5
    for n in (1, 2, 5, 26, 51, 52, 500):
        page = listing.read_page(spark, request(n), path)
        assert [r["id"] for r in page.collect()] == whole[20 * (n - 1) : 20 * n]
        scanned = page._jdf.queryExecution().executedPlan().toString()
        assert n > 51 or scanned.count("range#") > 0 and "PartitionFilters: []" not in scanned
    assert [r["id"] for r in listing.read_page(spark, ScanRequest(orderby=orderby, order=order, per_page="all", hard_cap=70), path).collect()] == whole[:70]
    listing.build_pages(rows.limit(0), request(1), path + "-none")
    assert listing.read_page(spark, request(1), path + "-none").count() == 0


def test_other_sites_are_not_read(spark, tmp_path):
    path, chosen = f"file://{tmp_path}/options", f"file://{tmp_path}/sites"
    options = spark.createDataFrame([(s, f"{'own_' if k % 2 else ''}k{k}", s and str(s)) for s in [1, 2, 3, 4, None] for k in range(10)], "site_id long, option_name string, option_value string")
    sites.write_sites(options, path)
    spark.createDataFrame([(s, "asked" if s < 3 else "kept", s == 1) for s in (1, 2, 3, 4, 9)] + [(1, "asked", True)], "site_id long, state string, delete_data boolean").write.parquet(chosen)
    left = sites.uninstalled_options(spark, path, spark.read.parquet(chosen).where("state = 'asked'"), ("own_",))
    assert sorted((r["site_id"], r["option_name"]) for r in left.collect()) == [(s, f"k{k}") for s in (1, 2) for k in (0, 2, 4, 6, 8)]
    assert "dynamicpruning" in left._jdf.queryExecution().executedPlan().toString().lower()
    meta = options.select("site_id", F.col("option_value").cast("long").alias("meta_id"), F.lit(1).cast("long").alias("post_id"), F.when(F.col("option_name") == "own_k1", "_d2g_divi_backup").otherwise(F.col("option_name")).alias("meta_key"), F.lit("v").alias("meta_value"))
    sites.write_sites(meta, path + "-meta")
    kept = sites.uninstalled_meta(spark, path + "-meta", spark.read.parquet(chosen).where("state = 'asked'"))
    assert {r["site_id"]: r["n"] for r in kept.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 9, 2: 10}
    sites.replace_sites(spark.createDataFrame(left.where("site_id = 1").collect(), left.schema), path)
    assert {r["site_id"]: r["n"] for r in spark.read.parquet(path).groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 5, 2: 10, 3: 10, 4: 10, None: 10}


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"_et_pb_use_builder":"on"}', {"_et_pb_use_builder": ["on"], "_et_pb_old_content": []}),
        ('{"_et_pb_use_builder":{"exists":true,"values":["a","b"]},"_et_pb_old_content":{"exists":true,"values":"c"}}', {"_et_pb_use_builder": ["a", "b"], "_et_pb_old_content": ["c"]}),
        ('{"_et_pb_old_content":["x"],"_et_pb_use_builder":null}', {"_et_pb_use_builder": [], "_et_pb_old_content": ["x"]}),
        ('{"_et_pb_use_builder":{"exists":false,"values":[]},"other":1}', {"_et_pb_use_builder": [], "_et_pb_old_content": []}),
        ('{"_et_pb_use_builder":5}', {"_et_pb_use_builder": ["5"], "_et_pb_old_content": []}),
        ("{}", None), ("[]", None), ('"on"', None), ("not json", None), (None, None), ("", None),
    ],
)
def test_shapes_of_stored_snapshots(spark, text, want):
    rows = [(1, 7, "_d2g_builder_meta", text), (2, 7, "_d2g_builder_meta", '{"_et_pb_use_builder":"later"}'), (3, 7, "_d2g_divi_backup", "b"), (4, 7, "_et_pb_use_builder", "now"), (5, 8, "_et_pb_use_builder", "other")]
    meta = spark.createDataFrame(rows, "meta_id long, post_id long, meta_key string, meta_value string")
    stored = writeplan.stored_snapshots(meta)
    assert {r["meta_key"]: r["values"] for r in stored.collect()} == (want or {}) and all(r["exists"] == bool(r["values"]) for r in stored.collect())
    after = sorted((r["post_id"], r["meta_key"], r["meta_value"] or "") for r in writeplan.restore_builder_meta(meta, stored).collect() if r["meta_key"] in ("_et_pb_use_builder", "_et_pb_old_content"))
    restored = [(7, k, v) for k, vs in want.items() for v in vs] if want else [(7, "_et_pb_use_builder", "on")]
    assert after == sorted([*restored, (8, "_et_pb_use_builder", "other")])


def test_kept_attachments_do_not_move(spark, tmp_path):
    from foliant.operators import documents, render

    docs = spark.createDataFrame([(i, f'[et_pb_gallery gallery_ids="{i % 7},{i}, 5000,x" /]') for i in range(1, 200)], "id long, post_content string")
    files = spark.createDataFrame([(i, f"https://e.com/{i}.png", None, None) for i in range(1, 150)], "id int, url string, file string, guid string")
    kept = attachments.keep_attachments(files, f"kept_{tmp_path.name}", f"file://{tmp_path}/kept", 4)
    assert kept.schema["id"].dataType.simpleString() == "bigint" and len(kept.inputFiles()) == 4
    nodes = documents.node_table(docs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        urls, plain = (render.gallery_urls(nodes, x, "https://c.example") for x in (kept, files))
        rows = lambda df: sorted((r["id"], tuple((g["image"], g["url"]) for g in r["gallery"])) for r in df.collect())
        assert rows(urls) == rows(plain)
        exchanges = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") for df in (urls, plain)]
        assert exchanges[0] == exchanges[1] - 1
        assert sorted(r["id"] for r in attachments.missing(nodes, kept).collect()) == [*range(150, 200), 5000]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE kept_{tmp_path.name}")
