"""An independent census of a document: words, links, images and buttons, before and after.

Built-in expressions only, and nothing of the tokenizer: a miscount there can't hide here. Each kind is counted by the
same rules on the source side and on the block side, so the two can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.places import once
from foliant.functions.sanitize import BLANKS, decode_entities

KINDS = ("words", "links", "images", "buttons")
#: The attributes that hold a URL, the JSON keys that do, and image endings.
URL_ATTRIBUTES = "src|url|button_url|button_link|image_url|background_image|audio|logo|src_webm"
JSON_KEYS = "url|href|src|mediaLink"
IMAGE = r"(?i)\.(?:jpe?g|png|gif|webp|svg|avif)(?:$|\?)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A bracketed tag; possessive, so that a long tag needs no deep stack.
TAG = r"""(?s)\[/?[a-zA-Z0-9_]++(?:[^\]"']++|"[^"]*+"|'[^']*+')*+\]"""


def _where(c: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """change(c) where c holds `mark`, without which it would change nothing."""
    return once(c, lambda t: F.when(F.contains(t, F.lit(mark)), change(t)).otherwise(t))


def straight_quotes(content: Column) -> Column:
    def straight(t: Column) -> Column:
        for entity in ("&quot;", "&#34;", "&#034;"):
            t = F.replace(t, F.lit(entity), F.lit('"'))
        return t

    return _where(content, "&", straight)


def visible_text(content: Column) -> Column:
    """What a reader sees of HTML (patterns are fixed values: both sides' counts depend on them)."""
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    return _where(_where(content, "<", plain), "&", decode_entities)


def word_count(text: Column) -> Column:
    """Tokens between Unicode white space that have a letter or digit and are no web address: one pass of one pattern, which
    can start only where a token starts and takes it whole."""
    token = r"(?U)(?<!\S)(?=\S*?[\p{L}\p{N}])(?!(?i:[a-z0-9_]+://|www\.))\S++"
    return F.regexp_count(text, F.lit(token)).cast("long")


def normal_url(url: Column) -> Column:
    """One spelling of a URL for both sides: decoded, without scheme and trailing slashes, lower case; '' if it counts for
    nothing."""
    v = F.btrim(decode_entities(url), F.lit(BLANKS))
    nothing = v.isin("", "#") | v.rlike(r"(?i)^\s*(?:javascript|data|vbscript)\s*:")
    plain = F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)
    plain = F.regexp_replace(F.regexp_replace(plain, "(?i)^https?://", ""), "/+$", "")
    return F.when(nothing, "").otherwise(F.translate(plain, UPPER, LOWER))


def _all(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def _after(name: str, mark: str, quotes: str) -> str:
    """A pattern whose group is the quoted value after a name and a mark."""
    return rf"(?i){name}\s*{mark}\s*[{quotes}]([^{quotes}]*)[{quotes}]"


def html_urls(content: Column) -> Column:
    """Addresses of links and sources, and those of blocks' JSON (names are fixed values: both sides' counts depend on them)."""
    found = F.concat(_all(content, _after(r"\b(?:href|src)", "=", '"')), _all(content, _after(f'"(?:{JSON_KEYS})"', ":", '"')))
    return F.filter(F.transform(found, normal_url), lambda u: u != "")


def attribute_urls(content: Column) -> Column:
    """Addresses of modules' attributes (names are fixed values)."""
    return F.filter(F.transform(_all(content, _after(rf"\b(?:{URL_ATTRIBUTES})", "=", "\"'")), normal_url), lambda u: u != "")


def _distinct(urls: Column, images: bool) -> Column:
    return F.size(F.array_distinct(F.filter(urls, lambda u: u.rlike(IMAGE) == F.lit(images)))).cast("long")


def source_census(content: Column) -> Column:
    """struct<words,links,images,buttons> of a shortcode document. Gallery images are counted as often as they are listed."""
    c = straight_quotes(F.coalesce(content, F.lit("")))
    urls = F.when(F.contains(c, F.lit("=")) | F.contains(c, F.lit(":")), F.concat(attribute_urls(c), html_urls(c))).otherwise(F.array().cast("array<string>"))
    lists = _all(c, r"""(?i)\bgallery_ids\s*=\s*["']([^"']*)["']""")
    listed = F.size(F.filter(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda i: F.btrim(i, F.lit(BLANKS)) != "")).cast("long")
    words = word_count(visible_text(_where(c, "[", lambda t: F.regexp_replace(t, TAG, " "))))
    buttons = F.regexp_count(c, F.lit(r"(?i)\[et_pb_(?:fullwidth_)?button\b")).cast("long")
    return once(urls, lambda u: F.struct(words.alias("words"), _distinct(u, False).alias("links"), (_distinct(u, True) + listed).alias("images"), buttons.alias("buttons")))


def block_census(content: Column) -> Column:
    """The same of a block document. Images inside galleries are counted, all others are told apart by URL."""
    c = straight_quotes(F.coalesce(content, F.lit("")))
    gallery = r"(?s)<!-- wp:gallery.*?<!-- /wp:gallery -->"
    inside = F.aggregate(_all(c, gallery, 0), F.lit(0).cast("long"), lambda n, g: n + F.regexp_count(g, F.lit(r"<!--\s+wp:image")))
    outside = html_urls(F.regexp_replace(c, gallery, " "))
    words = word_count(visible_text(F.regexp_replace(c, r"(?s)<!--\s*/?wp:.*?-->", " ")))
    buttons = F.regexp_count(c, F.lit(r"<!--\s+wp:button[\s/]")).cast("long")
    return F.struct(words.alias("words"), _distinct(html_urls(c), False).alias("links"), (_distinct(outside, True) + inside).alias("images"), buttons.alias("buttons"))


def unexplained(documents: DataFrame, key: str = "id") -> DataFrame:
    """key, kind, lost, before: one row for each kind of which `before` has more than `after` and `acknowledged` (a struct
    of the same fields, or null) together. Gains aren't losses."""
    rows = [F.struct(F.lit(k).alias("kind"), (F.col(f"before.{k}") - F.col(f"after.{k}") - F.coalesce(F.col(f"acknowledged.{k}"), F.lit(0))).alias("lost"), F.col(f"before.{k}").alias("before")) for k in KINDS]
    return documents.select(key, F.explode(F.array(*rows)).alias("loss")).select(key, "loss.*").where("lost > 0")


def census_warnings(losses: DataFrame, key: str = "id") -> DataFrame:
    """key, module, message for each unexplained loss."""
    return losses.select(key, F.lit("census").alias("module"), F.format_string("%d of %d %s missing from the result", "lost", "before", "kind").alias("message"))
