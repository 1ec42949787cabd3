"""Sanitisers of attribute values, as Column functions: what they return is safe to write, '' where nothing is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.places import once

BLANKS = " \t\n\r\0\x0b"
#: Units, keywords, widths, hosts and networks.
UNITS = "px|em|rem|%|vw|vh|pt|ch"
BORDER_STYLES = ("solid", "dashed", "dotted", "double", "groove", "ridge", "inset", "outset", "none")
ALIGNMENTS = ("left", "center", "right", "justify")
COLUMN_WIDTHS = {"4_4": "100%", "1_2": "50%", "1_3": "33.33%", "2_3": "66.66%", "1_4": "25%", "3_4": "75%", "1_5": "20%", "2_5": "40%", "3_5": "60%", "4_5": "80%", "1_6": "16.66%", "5_6": "83.33%"}
VIDEO_HOSTS = {"youtube.com": "youtube", "youtube-nocookie.com": "youtube", "youtu.be": "youtube", "vimeo.com": "vimeo"}
SOCIAL_NETWORKS = ("facebook", "twitter", "linkedin", "instagram", "youtube", "github", "pinterest", "tumblr", "dribbble")
FILTERED_ELEMENTS = ("script", "iframe", "object", "embed", "form", "style")
SIDES = ("top", "right", "bottom", "left")
#: Entities that are decoded, each once; & last, so that what it uncovers stays.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#034;": '"', "&#39;": "'", "&#039;": "'", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&#038;": "&", "&#38;": "&", "&amp;": "&"}


def trimmed(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def escape_text(c: Column) -> Column:
    """Decoded once, then escaped: `&amp;` and `&` both come out as `&amp;`."""
    return escape_decoded(decode_entities(F.coalesce(c, F.lit(""))))


def escape_decoded(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def allowed_value(c: Column, allowed: tuple[str, ...], default: str = "") -> Column:
    value = F.lower(trimmed(c))
    return F.when(value.isin(*allowed), value).otherwise(default)


def css_color(c: Column) -> Column:
    """Hex of 3, 4, 6 or 8 digits, rgb() or hsl() of numbers, or a keyword (lower-cased)."""
    v = trimmed(c)
    return F.when(v.rlike(r"(?i)^#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$") | v.rlike(r"(?i)^(?:rgba?|hsla?)\(\s*[0-9a-z.,%\s/-]*\)$"), v).when(v.rlike("^[a-zA-Z]+$"), F.lower(v)).otherwise("")


def css_length(c: Column) -> Column:
    """A number with a unit; a bare 0 is 0px."""
    v = F.lower(trimmed(c))
    return F.when(v == "0", "0px").when(v.rlike(rf"^-?[0-9]+(?:\.[0-9]+)?(?:{UNITS})$"), v).otherwise("")


def css_line_height(c: Column) -> Column:
    v = F.lower(trimmed(c))
    return F.when(v.rlike(r"^[0-9]+(?:\.[0-9]+)?$") & (v != ""), v).otherwise(css_length(c))


def css_border_style(c: Column) -> Column:
    return allowed_value(c, BORDER_STYLES)


def spacing_box(c: Column) -> Column:
    """struct<top,right,bottom,left> from a value of sides between bars; '' for a side without a length."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\|", -1)
    return F.struct(*[css_length(F.get(parts, i)).alias(side) for i, side in enumerate(SIDES)])


def border_radius(c: Column) -> Column:
    """struct<radius,mixed> from `on|a|b|c|d`: the radius if all four corners have the same; mixed if some differ."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\|", -1)
    corners = F.array(*[css_length(F.get(parts, i)) for i in range(1, 5)])
    filled = F.filter(corners, lambda x: x != "")
    on, kinds = F.lower(trimmed(F.get(parts, 0))) == "on", F.size(F.array_distinct(filled))
    uniform = on & (kinds == 1) & (F.size(filled) == 4)
    return F.struct(F.when(uniform, F.get(filled, 0)).otherwise("").alias("radius"), (on & (kinds > 0) & ~uniform).alias("mixed"))


def column_width(c: Column) -> Column:
    out = F.lit("")
    for kind, width in COLUMN_WIDTHS.items():
        out = F.when(c == kind, width).otherwise(out)
    return out


def text_align_class(c: Column) -> Column:
    return F.when(c.isin(*ALIGNMENTS), F.concat(F.lit("has-text-align-"), c)).otherwise("")


def safe_url(c: Column) -> Column:
    """Decoded, '' for nothing or for a scheme that runs code; otherwise with what a URL can't hold taken out."""
    return safe_decoded(decode_entities(F.coalesce(c, F.lit(""))))


def safe_decoded(v: Column) -> Column:
    clean = F.regexp_replace(F.replace(F.btrim(v, F.lit(BLANKS)), F.lit(" "), F.lit("%20")), r"[\x00-\x1f\x7f<>\"\\^`{|}]", "")
    return F.when(v.rlike(r"(?i)^\s*(?:javascript|data|vbscript)\s*:"), "").otherwise(clean)


def carries_no_value(name: Column, value: Column) -> Column:
    """A spacing attribute whose sides are all empty, apart from its trailing flags."""
    empty = F.forall(F.split(F.coalesce(value, F.lit("")), r"\|", -1), lambda x: F.btrim(x, F.lit(BLANKS)).isin("", "true", "false"))
    return name.rlike("^custom_(?:padding|margin)") & empty


def video_provider(c: Column) -> Column:
    """struct<provider,id,watch,is_embed> of a URL on a known host or a subdomain of one; provider is '' otherwise."""
    part = lambda i: F.regexp_extract(trimmed(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r":[0-9]*$", ""), r"\.+$", "")

    def named(u: Column) -> Column:
        on = lambda known: (u["host"] == known) | u["host"].endswith("." + known)
        provider = F.lit("")
        for known, name in reversed(VIDEO_HOSTS.items()):
            provider = F.when(on(known), name).otherwise(provider)
        embedded = F.regexp_extract(u["path"], r"^/(?:embed|v|shorts)/([a-zA-Z0-9_-]+)", 1)
        youtube = F.when(on("youtu.be"), F.regexp_extract(u["path"], r"^/([a-zA-Z0-9_-]+)", 1)).when(embedded != "", embedded).otherwise(F.regexp_extract(u["query"], r"(?:^|&)v=([a-zA-Z0-9_-]+)(?:&|$)", 1))
        number = F.regexp_extract(u["path"], r"^/(?:video/)?([0-9]+)", 1)
        return once(provider, lambda p: F.struct(p.alias("provider"), F.when(p == "youtube", youtube).when(p == "vimeo", number).otherwise("").alias("id"), (~on("youtu.be") & (embedded != "")).alias("framed"), u["host"].alias("host"), u["path"].alias("path")))

    def told(v: Column) -> Column:
        youtube = v["provider"] == "youtube"
        watch = F.when(v["id"] == "", "").when(youtube, F.concat(F.lit("https://www.youtube.com/watch?v="), v["id"])).otherwise(F.concat(F.lit("https://vimeo.com/"), v["id"]))
        embed = F.when(youtube, v["framed"]).when(v["provider"] == "vimeo", (v["id"] != "") & (v["path"].startswith("/video/") | v["host"].startswith("player."))).otherwise(False)
        return F.struct(v["provider"].alias("provider"), v["id"].alias("id"), watch.alias("watch"), embed.alias("is_embed"))

    return once(once(F.struct(host.alias("host"), part(2).alias("path"), part(3).alias("query")), named), told)


def strip_tags(c: Column) -> Column:
    """Text without script and style elements and without tags, trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)[^>]*?>.*?</\1>", ""), r"(?s)<[^>]*>", ""), F.lit(BLANKS))


def encoding_fingerprint(before: Column, after: Column) -> Column:
    """What happened to shortcode quotes between two texts: match, encodes_all, other or ''."""
    encoded = ~F.contains(before, F.lit("fb_built=&quot;")) & F.contains(after, F.lit("fb_built=&quot;"))
    return F.when(encoded & F.contains(after, F.lit('href="https://example.com/a"')), "match").when(encoded, "encodes_all").when(before != after, "other").otherwise("")


def filter_losses(before: Column, after: Column) -> Column:
    """map of element -> how many a filter took out, for the elements that filters take out, or {"attributes": 1} where it
    changed anything else; empty if the texts differ in nothing but the space before `/>`."""
    same = F.regexp_replace(before, r"\s*/>", "/>") == F.regexp_replace(after, r"\s*/>", "/>")
    lost = [F.struct(F.lit(e).alias("key"), F.greatest(F.regexp_count(before, F.lit(rf"(?i)<{e}\b")) - F.regexp_count(after, F.lit(rf"(?i)<{e}\b")), F.lit(0)).alias("value")) for e in FILTERED_ELEMENTS]
    named = F.filter(F.array(*lost), lambda x: ~same & (x["value"] > 0))
    other = F.array(F.struct(F.lit("attributes").alias("key"), F.lit(1).alias("value")))
    return F.map_from_entries(F.when(~same & (F.size(named) == 0), other).otherwise(named))
