"""Queries over documents that something is wrong with, made from the driver's texts: every reason to refuse a change, every broken
rule of the markup, losses that nothing explains. Bodies and verdicts are written out by hand; {t} stands for the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import census
from foliant.operators import documents, render, validate, writeplan
from foliant.plans.queries import _ATTACHMENTS, _CATALOG_SQL, attachments, query
from foliant.plans.shapes import _literal
from foliant.sources.corpus import BACKUP_KEY, table

_EMPTY = "trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11)) = ''"
#: body; why a change of it is refused, where its text is empty and otherwise; what becomes of a backup that differs; whether the
#: host's filter takes something from the backup `old <script>x</script>`
_PLANS = (
    ("[et_pb_text]{t}[/et_pb_text]", "empty_output", None, "refresh"),
    ("{t} [et_pb_text unclosed", "not_convertible", "not_convertible", "keep"),
    ("<!-- wp:paragraph --><p>x</p><!-- /wp:paragraph -->[et_pb_text]{t}[/et_pb_text]", "already_converted", "already_converted", "keep"),
    ("{t}[/et_pb_text]", "not_convertible", "not_convertible", "keep"),
    ("[et_pb_never_seen /]", "empty_output", "empty_output", "refresh"),
    ("[et_pb_text]{t}<script>x</script>[/et_pb_text]", "filter_loss", "filter_loss", "refresh"),
    ("[et_pb_text]a <!-- wp:paragraph --> {t}[/et_pb_text]", None, None, "refresh"),
    ("[et_pb_text] [/et_pb_text]", "empty_output", "empty_output", "refresh"),
    ("{t}", "not_convertible", "not_convertible", "keep"),
)


def _faulty(spark: SparkSession, sf_dir: str, cases: tuple, column: str = "post_content") -> DataFrame:
    """id and the body of each document that has a text, by its id's case."""
    body = f"CASE doc_id % {len(cases)} " + " ".join(f"WHEN {k} THEN {_literal(c[0], t='text')}" for k, c in enumerate(cases)) + " END"
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.expr(body).alias(column))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faulty(spark, sf_dir, _PLANS).select("id", F.lit("t").alias("post_title"), F.lit("post").alias("post_type"), F.lit("publish").alias("post_status"), F.lit(None).cast("date").alias("post_date"), "post_content")


def _backed(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.col("id").alias("post_id"), F.lit(BACKUP_KEY).alias("meta_key"), F.lit("old <script>x</script>").alias("meta_value")).withColumnRenamed("id", "meta_id")


_quoted = lambda x: "NULL" if x is None else f"'{x}'"
_by_case = lambda values: f"CASE doc_id % {len(_PLANS)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
_REASON = f"CASE WHEN {_EMPTY} THEN {_by_case(_quoted(c[1]) for c in _PLANS)} ELSE {_by_case(_quoted(c[2]) for c in _PLANS)} END"


@query(f"WITH d AS (SELECT doc_id, {_REASON} AS reason FROM documents WHERE text IS NOT NULL) SELECT doc_id AS post_id, CASE WHEN reason IS NULL THEN 'write' ELSE 'refuse' END AS status, reason FROM d")
def refused_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans over incomplete tags, bodies that are converted already, empty results, and markup that the host's filter takes from."""
    docs = _posts(spark, sf_dir)
    nodes = documents.node_table(docs, loose=True)
    made = render.convert(docs, nodes=nodes)
    filtered = made.select("id", F.regexp_replace("markup", "<script>.*</script>", "").alias("filtered"))
    asked = docs.select(F.col("id").alias("post_id"), F.md5("post_content").alias("source_hash"))
    return writeplan.change_plan(asked, docs, made, nodes, filtered).select("post_id", "status", "reason")


@query(f"SELECT doc_id AS post_id, {_by_case(_quoted(c[3]) for c in _PLANS)} AS action FROM documents WHERE text IS NOT NULL")
def stale_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of posts with a backup: whether it is replaced."""
    docs = _posts(spark, sf_dir)
    return writeplan.backup_plan(docs, _backed(docs), documents.node_table(docs)).select("post_id", "action")


@query("SELECT doc_id AS post_id, CASE lang WHEN 'en' THEN 'filter_loss' WHEN 'de' THEN 'no_backup' ELSE 'ok' END AS verdict FROM documents WHERE text IS NOT NULL")
def refused_restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restores of backups that the host's filter takes a script from, and of posts that have none."""
    docs = _posts(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    backed = _backed(docs.where("lang IS DISTINCT FROM 'de'"))
    filtered = docs.where("lang = 'en'").select("id", F.lit("old ").alias("filtered"))
    asked = docs.select(F.col("id").alias("post_id"), F.md5("post_content").alias("source_hash"))
    return writeplan.restore_plan(asked, docs, backed, filtered).select("post_id", "verdict")


#: body; problems
_MARKUP = (
    ("<!-- wp:group -->\n<!-- wp:paragraph -->\n<p>{t}</p>\n<!-- /wp:paragraph -->", ("unclosed group",)),
    ("<!-- wp:a --><!-- wp:b -->{t}<!-- /wp:a --><!-- /wp:b -->", ("crossed a", "crossed b")),
    ("{t}<!-- /wp:a -->", ("unopened a",)),
    ('<!-- wp:heading {"level":3} -->\n<h2>{t}</h2>\n<!-- /wp:heading -->', ("heading level differs",)),
    ("<!-- wp:heading -->\n{t}\n<!-- /wp:heading -->", ("heading is no h element",)),
    ('<!-- wp:paragraph {"align":"left"} -->\n<p>{t}</p>\n<!-- /wp:paragraph -->', ("alignment class and attribute differ",)),
    ("<!-- wp:paragraph -->\n<p class=\"has-text-align-right\">{t}</p>\n<!-- /wp:paragraph -->", ("alignment class and attribute differ",)),
    ('<!-- wp:spacer {"a":} /-->{t}', ("bad JSON in spacer",)),
    ("<!-- wp:paragraph -->\n<div>{t}</div>\n<!-- /wp:paragraph -->", ("paragraph is no p element",)),
    ("<!-- wp:list -->\n<p>{t}</p>\n<!-- /wp:list -->", ("list is no ul or ol element",)),
    ("<!-- wp:quote -->\n<p>{t}</p>\n<!-- /wp:quote -->", ("quote is no blockquote element",)),
    ("<!-- wp:table -->\n<p>{t}</p>\n<!-- /wp:table -->", ("table without a table element",)),
    ("<!-- wp:details -->\n<details>{t}</details>\n<!-- /wp:details -->", ("details without a summary",)),
    ('<!-- wp:navigation {"menuId":7} /-->{t}', ("navigation has no menuId",)),
    ("<!-- wp:form -->{t}<!-- wp:form-input /--><!-- /wp:form -->", ("form is no block of the host", "form-input is no block of the host")),
    ("<!-- wp:paragraph -->\n<p>{t}</p><p>x</p>\n<!-- /wp:paragraph -->", ("paragraph holds several p elements",)),
    ('<!-- wp:details {"showContent":true} -->\n<details><summary>x</summary>{t}</details>\n<!-- /wp:details -->', ("details are open in one place only",)),
    ("<!-- wp:details -->\n<details open><summary>x</summary>{t}</details>\n<!-- /wp:details -->", ("details are open in one place only",)),
    ("<!-- wp:list -->\n<ol><!-- wp:list-item -->\n<li>{t}</li>\n<!-- /wp:list-item --></ol>\n<!-- /wp:list -->", ("list element and order differ",)),
    ("<!-- wp:list -->\n<ul><li>{t}</li></ul>\n<!-- /wp:list -->", ("list items are no blocks",)),
    ("<!-- wp:table -->\n<figure><table><tr><td>{t}</td></tr></table></figure>\n<!-- /wp:table -->", ("table rows outside of a group",)),
    ("<!-- wp:quote -->\n<blockquote><p>{t}</p></blockquote>\n<!-- /wp:quote -->", ("quote holds loose markup",)),
    ("{t} [et_pb_text]", ("residual shortcode",)),
    ("<!-- wp:group -->\n<div><!-- wp:paragraph -->\n<p>{t}</p>\n<!-- /wp:paragraph --></div>\n<!-- /wp:group -->\n<!-- wp:spacer /-->", ()),
)


@query(" UNION ALL ".join(f"SELECT doc_id AS id, '{p}' AS problem FROM documents WHERE text IS NOT NULL AND doc_id % {len(_MARKUP)} = {k}" for k, (_, problems) in enumerate(_MARKUP) for p in problems))
def broken_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each break one rule of the markup, or none."""
    return validate.problems(_faulty(spark, sf_dir, _MARKUP, "markup"))


_LOSSES = ("SELECT doc_id AS id, CASE WHEN text IS NULL THEN NULL ELSE '[et_pb_button button_url=\"https://a.example/' || CAST(doc_id AS STRING) || '\" /][et_pb_image src=\"https://a.example/p.png\" /]one two three' END AS post_content, 'one ' || CASE lang WHEN 'en' THEN '<a href=\"https://a.example/' || CAST(doc_id AS STRING) || '\">two</a>' ELSE '' END AS markup, lang FROM documents WHERE text IS NOT NULL")


@query("""WITH d AS (SELECT doc_id AS id, lang FROM documents WHERE text IS NOT NULL), l AS (SELECT id, CASE lang WHEN 'en' THEN 1 ELSE 2 END AS lost, 3 AS before, 'words' AS kind FROM d UNION ALL SELECT id, 1, 1, 'links' FROM d WHERE lang IS DISTINCT FROM 'en' UNION ALL SELECT id, 1, 1, 'images' FROM d WHERE lang IS DISTINCT FROM 'de' UNION ALL SELECT id, 1, 1, 'buttons' FROM d)
SELECT id, 'census' AS module, lost || ' of ' || before || ' ' || kind || ' missing from the result' AS message FROM l""")
def loss_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of words, links, images and buttons that a conversion lost; an image of German documents is accounted for."""
    rows = spark.sql(_LOSSES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    known = F.when(F.col("lang") == "de", F.struct(*[F.lit(int(k == "images")).cast("long").alias(k) for k in census.KINDS]))
    facts = rows.select("id", census.source_census(F.col("post_content")).alias("before"), census.block_census(F.col("markup")).alias("after"), known.alias("acknowledged"))
    return census.census_warnings(census.unexplained(facts))


_CLAIMS = "SELECT DISTINCT 'et_pb_' || lang AS tag FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'et_pb_text' FROM (SELECT DISTINCT source FROM documents) s"


@query(f"""WITH cat AS ({_CATALOG_SQL}), claims AS ({_CLAIMS}) SELECT tag, 'duplicate' AS problem FROM claims GROUP BY tag HAVING count(*) > 1 UNION ALL SELECT DISTINCT tag, 'unknown' FROM claims WHERE tag NOT IN (SELECT tag FROM cat)
UNION ALL SELECT tag, 'unowned' FROM cat WHERE tag NOT IN (SELECT tag FROM claims) AND tag NOT IN ('et_pb_contact_field', 'et_pb_map_pin', 'et_pb_video_slider_item')""")
def dispatch_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """If languages were modules, and every source claimed the text module."""
    claims = spark.sql(_CLAIMS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return documents.dispatch_problems(claims, documents.module_catalog(spark))


_FOUND = "coalesce(att.url, 'https://cdn.example.com/' || att.file, att.guid)"
_IMAGE = _literal(
    '<!-- wp:gallery {"columns":3,"linkTo":"media","imageCrop":true} -->\n<figure class="wp-block-gallery has-nested-images columns-3 is-cropped">\n<!-- wp:image {"id":{i},"sizeSlug":"large","linkDestination":"media","url":"{json}","alt":"A \\u0022{i}\\u0022"} -->\n<figure class="wp-block-image size-large"><img src="{url}" alt="A &quot;{i}&quot;" class="wp-image-{i}"/><figcaption class="wp-element-caption">C &amp; {i}</figcaption></figure>\n<!-- /wp:image -->\n\n</figure>\n<!-- /wp:gallery -->',
    i="CAST(att.id AS STRING)", url=f"replace({_FOUND}, '&', '&amp;')", json=f"replace(replace({_FOUND}, '--', '\\u002d\\u002d'), '&', '\\u0026')",
)


@query(f"WITH att AS ({_ATTACHMENTS}) SELECT att.id, {_IMAGE} AS markup FROM att WHERE att.id > 0 AND {_FOUND} IS NOT NULL")
def gallery_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gallery of each attachment that has an address, with the library's alternative text and caption."""
    files = attachments(spark, sf_dir).withColumns({"alt": F.concat(F.lit('A "'), F.col("id").cast("string"), F.lit('"')), "caption": F.concat(F.lit("C & "), F.col("id").cast("string"))})
    docs = files.where("id > 0 AND coalesce(url, file, guid) IS NOT NULL").select("id", F.concat(F.lit('[et_pb_gallery gallery_ids="'), F.col("id").cast("string"), F.lit('" /]')).alias("post_content"))
    return render.convert(docs, files, "https://cdn.example.com")
