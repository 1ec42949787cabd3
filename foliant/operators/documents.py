"""Documents as flat tables: tag spans and nodes, and the relational questions that are asked of them.

The tokenizer runs in Arrow batches, behind a built-in substring test that spares documents without a tag. It emits rows;
everything above it - detection, coverage, losses, rendering - is joins, windows and grouped aggregates.
"""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import batches as small
from foliant.functions import places, sanitize
from foliant.functions.shortcodes import TEXT
from foliant.operators.inventory import SHORTCODE

SPANS = "id long, ordinal int, tag string, start int, end int, attrs_str string, closing boolean, self_closing boolean"
NODES = "id long, node_id int, parent_id int, ordinal int, depth int, tag string, attrs array<struct<name:string,value:string>>, content string, last_id int, own_text string, columns int, parent_tag string"
#: Two more columns for rendering: the attributes that style a text node, and the text as blocks of HTML.
LOOSE = "around array<struct<name:string,value:string>>, blocks array<struct<kind:string,level:int,html:string>>"

#: Every module tag that the source format defines, without its prefix (fixed values).
MODULES = (
    "section row row_inner column column_inner text image button video blurb slider slide toggle accordion tabs tab cta divider gallery blog contact_form contact_field sidebar testimonial "
    "pricing_tables pricing_table pricing_item counter counters number_counter circle_counter social_media_follow social_media_follow_network map map_pin code signup login portfolio filterable_portfolio "
    "fullwidth_header fullwidth_image fullwidth_slider fullwidth_code fullwidth_menu fullwidth_map fullwidth_portfolio fullwidth_post_slider post_slider audio team_member shop search menu post_title comments video_slider video_slider_item"
).split()
PREFIX = "et_pb_"
#: Tags that their parents consume (fixed values).
CONSUMED = ("contact_field", "map_pin", "video_slider_item")
#: Modules whose settings style the loose text inside them.
STYLING = ("text", "blurb", "cta", "fullwidth_header", "testimonial", "team_member", "social_media_follow", "toggle", "tabs", "tab", "slide", "counters", "pricing_tables", "pricing_table", "video_slider")
#: What a design attribute is, by the first pattern that its name fits (the patterns are fixed values of the format).
STYLE_LABELS = (
    (r"_(tablet|phone)$", "settings for smaller screens"),
    (r"(^hover_enabled$|__hover$)", "changes on hover"),
    (r"^custom_(padding|margin)", "inner and outer spacing"),
    (r"^(max_width|min_height|width|height)($|_)", "fixed sizes"),
    (r"^border_", "border lines"),
    (r"^box_shadow_", "shadows of boxes"),
    (r"^text_shadow_", "shadows of text"),
    (r"_(font|font_size|line_height|letter_spacing)($|_)", "font settings"),
    (r"^background_(gradient|blend|size|position|repeat)", "background details"),
    (r"^parallax", "moving backgrounds"),
    (r"^(animation|filter_)", "animations and filters"),
    (r"^custom_css", "own CSS"),
    (r"^module_(id|class)$", "own ids and classes"),
    (r"^(transform_|sticky_|z_index|positioning)", "placement and transforms"),
    (r"^disabled_on$", "visibility by device"),
    (r"^(header_|body_)?text_color$", "colour of text"),
)


def tag_spans(docs: DataFrame) -> DataFrame:
    """One row for each tag of `docs` (id, post_content), in code points from the start; documents without one have none."""

    def each(batches):
        from foliant.functions import shortcodes

        for b in small.parts(batches, 1):
            rows = [(i, k, *s) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, s in enumerate(shortcodes.tag_spans(text))]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SPANS.split(", ")])

    return _bodies(docs).mapInArrow(each, SPANS)


def node_table(docs: DataFrame, loose: bool = False, timed: bool = False) -> DataFrame:
    """One row for each node of the trees of `docs` (id, post_content) that hold a tag, numbered in document order; with the
    columns of LOOSE, if asked for, empty for all but text nodes; and with ms, the time that the document took."""
    styling = {PREFIX + m for m in STYLING}

    def each(batches):
        from foliant.functions import loose_html, shortcodes

        pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        piece = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("html", pa.string())]))
        kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), pair, pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        names = [x.split()[0] for x in NODES.split(", ")]
        rows_of = lambda pairs: [{"name": k, "value": v} for k, v in pairs]
        for b in small.parts(batches, 1):
            found, taken = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                began = time.perf_counter()
                found.append((i, shortcodes.nodes(text)))
                taken.append(1000 * (time.perf_counter() - began))
            columns = list(zip(*[(i, *n) for i, tree in found for n in tree], strict=True)) or [()] * len(names)
            columns[6] = [rows_of(attrs) for attrs in columns[6]]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            if loose:
                centred = {"et_pb_fullwidth_header": [("text_orientation", "center")]}
                texts = [(n.tag == shortcodes.TEXT, n, tree) for _, tree in found for n in tree]
                around = [rows_of(dict([*tree[n.parent_id].attrs, *centred.get(n.parent_tag, [])]).items()) if is_text and n.parent_tag in styling else [] for is_text, n, tree in texts]
                cut = []
                for k, (_, tree) in enumerate(found):
                    began = time.perf_counter()
                    cut += [[{"kind": k, "level": v, "html": h} for k, v, h in loose_html.blocks(n.content)] if n.tag == shortcodes.TEXT else [] for n in tree]
                    taken[k] += 1000 * (time.perf_counter() - began)
                arrays += [pa.array(around, pair), pa.array(cut, piece)]
            if timed:
                arrays.append(pa.array([ms for ms, (_, tree) in zip(taken, found, strict=True) for _ in tree], pa.float64()))
            yield pa.RecordBatch.from_arrays(arrays, names=names + ["around", "blocks"] * loose + ["ms"] * timed)

    return _bodies(docs).mapInArrow(each, NODES + (", " + LOOSE) * loose + ", ms double" * timed)


def _bodies(docs: DataFrame) -> DataFrame:
    small.bound(docs.sparkSession)
    return docs.select(F.col("id").cast("long"), "post_content").where(F.contains("post_content", F.lit("[")) & F.col("post_content").rlike(r"\[/?et_pb_"))


def found_tags(spans: DataFrame) -> DataFrame:
    """id, tags: the distinct opening tags of each document in the order of first mention."""
    first = spans.where("not closing").groupBy("id", "tag").agg(F.min("ordinal").alias("first"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"]).alias("tags"))


def module_catalog(spark: SparkSession) -> DataFrame:
    """tag, dispatched: every known tag, and whether it is rendered by itself. A few dozen rows."""
    return spark.createDataFrame([(PREFIX + m, m not in CONSUMED) for m in MODULES], "tag string, dispatched boolean")


def module_coverage(spans: DataFrame) -> DataFrame:
    """tag, uses, documents, known: used tags with their counts, and known tags that are never used (0)."""
    used = spans.where("not closing").groupBy("tag").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("id").alias("documents"))
    catalog = module_catalog(spans.sparkSession).select("tag", F.lit(True).alias("known"))
    joined = used.join(F.broadcast(catalog), "tag", "left").unionByName(catalog.join(used, "tag", "left_anti").select("tag", F.lit(0).alias("uses"), F.lit(0).alias("documents"), "known"))
    return joined.select("tag", F.col("uses").cast("long"), F.col("documents").cast("long"), F.coalesce("known", F.lit(False)).alias("known"))


def dispatch_problems(claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """tag, problem: duplicate (claimed twice), unowned (known, dispatched and claimed by none) or unknown (claimed, not known)."""
    twice = claims.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tag", F.lit("duplicate").alias("problem"))
    unowned = catalog.where("dispatched").join(claims, "tag", "left_anti").select("tag", F.lit("unowned").alias("problem"))
    unknown = claims.join(catalog, "tag", "left_anti").select("tag", F.lit("unknown").alias("problem")).distinct()
    return twice.unionByName(unowned).unionByName(unknown)


def holds_converted_blocks(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id of the documents with a block delimiter, of another format than the newer builder's, in text at the top level."""
    pattern = r"<!--\s+wp:(?!divi/)"
    whole = docs.where(F.col("post_content").rlike(pattern))
    plain = whole.join(nodes.select("id").distinct(), "id", "left_anti").select("id")
    held = nodes.where(F.col("parent_id").isNull() & (F.col("tag") == TEXT) & F.col("content").rlike(pattern)).select("id").distinct()
    return plain.unionByName(held)


def inner_content(nodes: DataFrame) -> DataFrame:
    """id, node_id, text of each module: its raw content, or only its own text parts, joined by line feeds, where it has
    module children."""
    children = nodes.where(F.col("parent_id").isNotNull()).groupBy("id", F.col("parent_id").alias("node_id")).agg(F.count_if(F.col("tag") != TEXT).alias("modules"), F.array_sort(F.collect_list(F.when(F.col("tag") == TEXT, F.struct("ordinal", "content")))).alias("parts"))
    joined = nodes.where(F.col("tag") != TEXT).select("id", "node_id", "content").join(children, ["id", "node_id"], "left")
    own = F.array_join(F.transform("parts", lambda x: x["content"]), "\n")
    return joined.select("id", "node_id", F.when(F.coalesce("modules", F.lit(0)) > 0, own).otherwise(F.btrim("content", F.lit(sanitize.BLANKS))).alias("text"))


def sibling_runs(nodes: DataFrame, expected: Column) -> DataFrame:
    """id, parent_id, run, first_ordinal, members: maximal runs of expected siblings (gaps and islands). Siblings that are
    only white space don't stand in the node table and so don't break a run."""
    w = Window.partitionBy("id", "parent_id").orderBy("ordinal")
    flagged = nodes.withColumn("_other", (~expected).cast("int")).withColumn("run", F.sum("_other").over(w))
    return flagged.where("_other = 0").groupBy("id", "parent_id", "run").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("members"))


def style_losses(nodes: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """id, tag, labels: for each document and module the kinds of design that its attributes carry and that `mapped` (tag,
    name; a small table of pairs) doesn't, in the order of first mention. Empty values carry nothing."""
    named = nodes.where(F.size("attrs") > 0).select("id", "node_id", "tag", F.posexplode("attrs").alias("place", "attr")).select("id", "node_id", "place", "tag", "attr.name", "attr.value")
    return lost_styles(named, mapped)


def lost_styles(named: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """The same of attributes (id, node_id, place, tag, name, value)."""
    named = named.where(~sanitize.carries_no_value(F.col("name"), F.col("value")) & (F.btrim("value", F.lit(sanitize.BLANKS)) != ""))
    if mapped is not None:
        named = named.join(F.broadcast(mapped) if mapped.count() <= 10_000 else mapped, ["tag", "name"], "left_anti")
    label = F.lit(None).cast("string")
    for pattern, text in reversed(STYLE_LABELS):
        label = F.when(F.col("name").rlike(pattern), text).otherwise(label)
    first = named.withColumn("label", label).where("label is not null").groupBy("id", "tag", "label").agg(F.min(F.struct("node_id", "place")).alias("first"))
    return first.groupBy("id", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]), ", ").alias("labels"))


def strip_shortcodes(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """id, stripped: the documents without their tags, closers included, cut by the spans' places."""
    found = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = docs.select("id", "post_content").join(found, "id", "left")

    def kept(cut: Column) -> Column:
        gaps = F.transform("spans", lambda s, i: places.between(cut, F.when(i == 0, 0).otherwise(F.get(F.col("spans"), i - 1)["end"]), s["start"]))
        return F.concat(F.array_join(gaps, ""), places.between(cut, F.element_at("spans", -1)["end"], F.length("post_content")))

    stripped = places.once(places.chunks(F.col("post_content")), kept)
    return joined.select("id", F.when(F.col("spans").isNull(), F.col("post_content")).otherwise(stripped).alias("stripped"))


def skeleton(spans: DataFrame) -> DataFrame:
    """id, skeleton: each document's tags, openers, closers and self-closers, without attributes or text."""
    shape = F.concat(F.lit("["), F.when(F.col("closing"), "/").otherwise(""), F.col("tag"), F.when(F.col("self_closing"), " /").otherwise(""), F.lit("]"))
    rows = spans.select("id", "ordinal", shape.alias("shape"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "shape"))), lambda x: x["shape"]), "").alias("skeleton"))
