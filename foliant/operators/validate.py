"""Checks of block markup: delimiters, their balance, bodies at every depth, and house rules of the blocks.

Delimiters are rows, or for the rules arrays of their document; nesting is a running sum; an opener's closer is the next delimiter
of its level. No stack is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.places import match_places, once, running_totals

DELIMITER = r"(?s)<!--\s+/?wp:[a-z][a-z0-9_/-]*(?:\s+\{(?:(?!-->).)*+)?\s*/?-->"
#: Blocks with house rules.
RULED = ("paragraph", "heading", "details", "list", "table", "quote")
_PARTS = r"(?s)^<!--\s+(/?)wp:([a-z][a-z0-9_/-]*)(?:\s+(\{(?:(?!-->).)*?\}))?\s*(/?)-->$"


def block_comments(docs: DataFrame, column: str = "markup") -> DataFrame:
    """id, ordinal, name, attrs (JSON or ''), closing, self_closing, start, end: each delimiter of each document."""
    rows = docs.select("id", F.posexplode(match_places(F.coalesce(column, F.lit("")), DELIMITER)).alias("ordinal", "m"))
    part = lambda i: F.regexp_extract("m.found", _PARTS, i)
    return rows.select("id", "ordinal", part(2).alias("name"), part(3).alias("attrs"), (part(1) == "/").alias("closing"), (part(4) == "/").alias("self_closing"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def _levels(comments: DataFrame) -> DataFrame:
    """Delimiters that open or close, with their level and the delimiter that follows on the same level."""
    order = Window.partitionBy("id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    paired = comments.where("not self_closing").withColumn("level", F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(order) + F.col("closing").cast("int"))
    same = Window.partitionBy("id", "level").orderBy("ordinal")
    return paired.withColumns({"next_name": F.lead("name").over(same), "next_closing": F.lead("closing").over(same), "next_start": F.lead("start").over(same), "before": F.lag("closing").over(same)})


def block_bodies(docs: DataFrame, comments: DataFrame, column: str = "markup") -> DataFrame:
    """id, name, attrs, level, body: what stands between each opener and its closer, at every depth."""
    matched = _levels(comments).where("not closing and next_closing and name = next_name")
    return matched.join(docs.select("id", F.col(column).alias("_markup")), "id").select("id", "name", "attrs", "level", F.expr("substring(_markup, end + 1, next_start - end)").alias("body"))


def _paired(comments: Column) -> Column:
    """Of a document's delimiters those that open or close, with their level, in the order of level and place: what follows one in
    the array is the next of its level, if it has the same."""

    def levelled(ends: Column) -> Column:
        totals = running_totals(F.transform(ends, lambda c: F.when(c["closing"], -1).otherwise(1)))
        return F.array_sort(F.zip_with(ends, totals, lambda c, n: F.struct((n + c["closing"].cast("int")).alias("level"), c["start"].alias("at"), c.alias("c"))))

    return once(F.filter(comments, lambda c: ~c["self_closing"]), levelled)


def _rule(c: Column, body: Column) -> Column:
    """The house rule that a block breaks whose opener is c, or null."""
    attr = lambda name: F.get_json_object(c["attrs"], f"$.{name}")
    set_ = lambda name: F.coalesce(attr(name) == "true", F.lit(False))
    align = F.coalesce(attr("align"), attr("textAlign"), F.lit(""))
    classed = F.regexp_extract(F.regexp_extract(body, r"<(?:p|h[1-6])\b[^>]*>", 0), r"has-text-align-(left|center|right)", 1)
    level = F.coalesce(attr("level"), F.lit("2"))
    body = F.trim(F.regexp_replace(body, r"^\s+|\s+$", ""))
    rule = {
        "paragraph": F.when(body.rlike(r"(?is)<p[\s>].*<p[\s>]"), "paragraph holds several p elements").when((body != "") & ~body.rlike(r"(?s)^<p\b[^>]*>.*</p>$"), "paragraph is no p element").when(align != classed, "alignment class and attribute differ"),
        "heading": F.when(~body.rlike(r"(?s)^<(h[1-6])\b[^>]*>.*</\1>$"), "heading is no h element").when(F.regexp_extract(body, r"^<h([1-6])", 1) != level, "heading level differs").when(align != classed, "alignment class and attribute differ"),
        "details": F.when(~body.rlike(r"(?s)^<details\b[^>]*><summary>.*</summary>.*</details>$"), "details without a summary").when(body.rlike(r"^<details\b[^>]*\sopen[\s>]") != set_("showContent"), "details are open in one place only"),
        "list": F.when(~body.rlike(r"(?s)^<([uo]l)\b.*</\1>$"), "list is no ul or ol element").when(body.startswith("<ol") != set_("ordered"), "list element and order differ").when(body.rlike(r"<li[\s>]") & ~body.contains("<!-- wp:list-item"), "list items are no blocks"),
        "table": F.when(~body.rlike(r"(?s)<table\b.*</table>"), "table without a table element").when(body.rlike(r"<tr[\s>]") & ~body.rlike(r"<t(?:body|head|foot)[\s>]"), "table rows outside of a group"),
        "quote": F.when(~body.rlike(r"(?s)^<blockquote\b.*</blockquote>$"), "quote is no blockquote element").when(body.rlike(r"^<blockquote[^>]*>\s*<p"), "quote holds loose markup"),
    }
    ruled = F.lit(None).cast("string")
    for name, broken_rule in rule.items():
        ruled = F.when(c["name"] == name, broken_rule).otherwise(ruled)
    return ruled


def _foreign(c: Column) -> Column:
    ours = F.when(c["name"].isin("form", "form-input", "form-submit-button"), F.concat(c["name"], F.lit(" is no block of the host")))
    return F.when(~c["closing"], ours.when((c["name"] == "navigation") & F.get_json_object(c["attrs"], "$.menuId").isNotNull(), "navigation has no menuId"))


def problems(docs: DataFrame, column: str = "markup") -> DataFrame:
    """id, problem: one row for each broken rule of each document; none for a valid one. Delimiters, levels and bodies are arrays of
    the document's own row, so `docs` is read once and nothing is moved."""
    part = lambda m, i: F.regexp_extract(m["found"], _PARTS, i)
    text = F.coalesce(column, F.lit(""))
    comments = F.transform(match_places(text, DELIMITER), lambda m: F.struct(part(m, 2).alias("name"), part(m, 3).alias("attrs"), (part(m, 1) == "/").alias("closing"), (part(m, 4) == "/").alias("self_closing"), m["start"].alias("start"), m["end"].alias("end")))

    def of_pair(x: Column, before: Column, after: Column) -> Column:
        c, following = x["c"], F.when(after["level"] == x["level"], after["c"])
        unopened = c["closing"] & F.coalesce(F.when(before["level"] == x["level"], before["c"]["closing"]), F.lit(True))
        unclosed, name = F.coalesce(~following["closing"], F.lit(True)), lambda said: F.concat(F.lit(said), c["name"])
        balance = F.when(c["closing"], F.when(unopened, name("unopened "))).when(unclosed, name("unclosed ")).when(c["name"] != following["name"], name("crossed "))
        closed = ~c["closing"] & following["closing"] & (c["name"] == following["name"]) & c["name"].isin(*RULED)
        rule = F.when(closed, once(F.substring(text, c["end"] + 1, following["start"] - c["end"]), lambda body: _rule(c, body)))
        return F.array(balance, rule)

    def of_all(found: Column) -> Column:
        pairs = once(_paired(found), lambda p: F.flatten(F.transform(p, lambda x, i: of_pair(x, F.get(p, i - 1), F.get(p, i + 1)))))
        bad_json = F.transform(found, lambda c: F.when((c["attrs"] != "") & F.try_parse_json(c["attrs"]).isNull(), F.concat(F.lit("bad JSON in "), c["name"])))
        return F.concat(pairs, bad_json, F.transform(found, _foreign))

    residual = F.when(F.col(column).rlike(r"\[/?et_pb_[a-z0-9_]+[\]/\s]"), "residual shortcode")
    rows = docs.select("id", F.explode(F.concat(once(comments, of_all), F.array(residual))).alias("problem"))
    return rows.where("problem is not null")
