"""Rendering as a relational job: every node of the node table becomes an opening and a closing piece of block markup by an
expression chosen by its tag, and a document is its pieces in order, joined by one grouped aggregate.

A node's opening piece stands at its own number, its closing piece after the last node of its subtree; inner nodes close
first. Modules that use their text as a label swallow their subtree. What siblings or children decide (a row with columns,
a run of list items, the last of two equal networks) comes from windows over siblings. Loose HTML comes from the tokenizer's
pass as a flat list of blocks, which an expression writes out. Nothing here is Python per row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import sanitize as S
from foliant.functions.loose_html import PLAIN
from foliant.functions.places import once
from foliant.functions.shortcodes import TEXT
from foliant.operators.documents import PREFIX, lost_styles, node_table


@dataclass(frozen=True)
class Target:
    """What the markup is written for: the host's version, blocks that it lacks, and where portfolios are kept."""

    version: tuple[int, int] = (99, 0)
    lacks: frozenset[str] = frozenset()
    portfolio_type: str = "project"
    portfolio_taxonomy: str = "project_category"

    def at_least(self, major: int, minor: int) -> Column:
        return F.lit(self.version >= (major, minor))

    def has(self, block: str) -> Column:
        return F.lit(f"core/{block}" not in self.lacks)

    def portfolio(self) -> tuple[Column, Column]:
        """Post type and taxonomy."""
        return F.lit(self.portfolio_type), F.lit(self.portfolio_taxonomy)

    def row(self) -> Column:
        """As a value of the column that `OwnTarget` reads."""
        return F.struct(F.lit(self.version[0]).alias("major"), F.lit(self.version[1]).alias("minor"), F.array(*[F.lit(x) for x in sorted(self.lacks)]).cast("array<string>").alias("lacks"), F.lit(self.portfolio_type).alias("portfolio_type"), F.lit(self.portfolio_taxonomy).alias("portfolio_taxonomy"))


@dataclass(frozen=True)
class OwnTarget:
    """Each document's own target, in the column `target`: one run writes for as many hosts as there are."""

    def at_least(self, major: int, minor: int) -> Column:
        return (F.col("target.major") > major) | (F.col("target.major") == major) & (F.col("target.minor") >= minor)

    def has(self, block: str) -> Column:
        return ~F.array_contains("target.lacks", f"core/{block}")

    def portfolio(self) -> tuple[Column, Column]:
        return F.col("target.portfolio_type"), F.col("target.portfolio_taxonomy")


def targets_of(docs: DataFrame, sites: DataFrame) -> DataFrame:
    """id, target of the documents (id, site_id) by their site's row in `sites` (site_id, major, minor, lacks, portfolio_type,
    portfolio_taxonomy); what is null there, or a site without a row, is as in `Target`."""
    usual = Target().row()
    known = sites.select("site_id", *[F.coalesce(k, usual[k]).alias(k) for k in ("major", "minor", "lacks", "portfolio_type", "portfolio_taxonomy")])
    held = F.struct(*known.columns[1:])
    return docs.select("id", "site_id").join(known, "site_id", "left").select("id", F.when(F.col("major").isNotNull(), held).otherwise(usual).alias("target"))


#: Modules whose text is a label or verbatim code: nodes inside them aren't rendered on their own.
SWALLOWING = ("code", "fullwidth_code", "counter", "pricing_item", "image", "fullwidth_image", "video", "contact_field", "map_pin", "gallery", "audio", "blog", "menu", "fullwidth_menu", "search", "portfolio", "filterable_portfolio", "fullwidth_portfolio", "divider", "button", "number_counter", "circle_counter", "post_title", "comments", "login", "sidebar", "shop", "social_media_follow_network", "signup")
MAPS = ("map", "fullwidth_map")
#: Parents that draw children of one kind themselves; whatever else stands in them is rendered in place, with a warning.
EXPECTS = {"tabs": "tab", "counters": "counter", "pricing_tables": "pricing_table", "pricing_table": "pricing_item", "social_media_follow": "social_media_follow_network", "video_slider": "video_slider_item"}
SPACING = ("custom_padding", "custom_margin")
BODY_TYPE = ("body_text_color", "body_font_size", "body_line_height", "body_letter_spacing")
HEADER_TYPE = ("header_text_color", "header_font_size", "header_line_height", "header_letter_spacing")
WRAPPER = (*SPACING, "background_color", "border_width_all", "border_color_all", "border_style_all", "border_radii")
#: Design attributes that a module's rendering carries over (fixed values).
MAPPED: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("section", "row", "row_inner", "column", "column_inner"), WRAPPER),
    **dict.fromkeys(("button", "divider", "image", "fullwidth_image", "video", "audio", "gallery", "video_slider"), SPACING),
    **dict.fromkeys(("cta", "blurb", "testimonial", "team_member", "fullwidth_header", "toggle", "tab"), BODY_TYPE),
    "text": (*BODY_TYPE, *HEADER_TYPE, *SPACING),
}
#: What a module loses whenever it is rendered.
NOTES = {
    "accordion": "An accordion became independent details blocks; opening one no longer closes the others.",
    "tabs": "Tabs became headed sections, one below the other, all visible at once.",
    "counter": "A bar counter became a line of text; its bar and animation were not carried over.",
    "video_slider": "A video slider became a stack of videos.",
    **dict.fromkeys(("number_counter", "circle_counter"), "A counter became a static heading; its animation was not carried over."),
    **dict.fromkeys(("slider", "fullwidth_slider", "post_slider", "fullwidth_post_slider"), "A slider became a stack of sections, one per slide, all visible at once."),
    **dict.fromkeys(MAPS, "A map became text: its address and pins."),
    **dict.fromkeys(("portfolio", "filterable_portfolio", "fullwidth_portfolio"), "A portfolio became a query over its post type, which must be registered by something else."),
    "sidebar": "A sidebar became a placeholder; add its widgets as blocks.",
    "shop": "A shop module became a placeholder; add the shop's own blocks.",
    "contact_form": "A contact form became a list of its fields; rebuild it with a form plugin.",
    "signup": "A sign-up form became text; rebuild it with the provider's block.",
}
UNEXPECTED = "Content that this module does not hold of itself was kept in its place; check where it landed."
#: What loose HTML loses, by the kind of the note: module and message.
HTML_NOTES = {
    "delimiter": ("html-comment", "A block delimiter inside the content was removed."),
    "table_attribute": ("table", "A table with attributes was kept as HTML."),
    "table_child": ("table", "A table with an element that the table block does not hold was kept as HTML."),
}


def _a(name: str) -> Column:
    """An attribute of the node, null if it isn't there."""
    return F.element_at("a", name)


def _given(c: Column) -> Column:
    """Neither missing nor empty nor "0", which the source format's own language holds for false."""
    return F.coalesce(c, F.lit("")).isin("", "0") == F.lit(False)


def _u(name: str) -> Column:
    """A URL attribute, safe or ''."""
    return F.coalesce(F.element_at("urls", name), F.lit(""))


def _e(name: str) -> Column:
    """The same, escaped."""
    return F.coalesce(F.element_at("escaped_urls", name), F.lit(""))


def _t(name: str, default: str = "") -> Column:
    """A text attribute, escaped."""
    return F.coalesce(F.element_at("texts", name), F.lit(default))


def _int(c: Column, default: str) -> Column:
    """The whole number that a text starts with, 0 without one; of `default` where there is no text."""
    return F.coalesce(F.regexp_extract(F.coalesce(c, F.lit(default)), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))


def _is(*modules: str) -> Column:
    return F.col("tag").isin(*[PREFIX + m for m in modules])


def _in(*modules: str) -> Column:
    return F.coalesce(F.col("parent_tag").isin(*[PREFIX + m for m in modules]), F.lit(False))


def _label(c: Column) -> Column:
    """Text without tags, in one line."""
    return F.regexp_replace(S.strip_tags(c), r"[\r\n\t ]+", " ")


def _prepared(rows: DataFrame) -> DataFrame:
    """`rows` with what many modules share: each attribute cleaned once as a URL and once as text, boxes and styles."""

    def where(holds: str, clean: Callable[[Column], Column]) -> Callable[[Column], Column]:
        """`clean`, where a value holds a character that it changes: most hold none."""
        return lambda v: F.when(v.rlike(holds), clean(v)).otherwise(v)

    def cleaned(source: str, clean: Callable[[Column], Column]) -> Column:
        return F.transform(source, lambda x: F.struct(x["name"].alias("key"), clean(x["value"]).alias("value")))

    rows = rows.withColumn("decoded", F.transform("attrs", lambda x: F.struct(x["name"].alias("name"), where("&", S.decode_entities)(F.coalesce(x["value"], F.lit(""))).alias("value"))))
    special = "[&<>\"']"
    rows = rows.withColumns({"urls": F.map_from_entries(cleaned("decoded", where(r"[\x00-\x20\x7f<>\"\\^`{|}:]", S.safe_decoded))), "texts": F.map_from_entries(cleaned("decoded", where(special, S.escape_decoded))), "r": F.map_from_entries("around")})
    rows = rows.withColumn("escaped_urls", F.transform_values("urls", lambda _, v: where(special, S.escape_text)(v)))
    rows = rows.withColumns({"margin": S.spacing_box(_a("custom_margin")), "padding": S.spacing_box(_a("custom_padding")), "back": S.css_color(_a("background_color")), "radius": S.border_radius(_a("border_radii"))["radius"], "border_color": S.css_color(_a("border_color_all")), "border_style": S.css_border_style(_a("border_style_all")), "border_width": S.css_length(_a("border_width_all"))})
    justified = S.allowed_value(F.coalesce(_a("button_alignment"), _a("text_orientation")), ("left", "center", "right", "space-between"))
    rows = rows.withColumns({"host": S.video_provider(F.col("video_src")), "color": S.css_color(_a("color")), "width": S.column_width(_a("type")), "button_align": justified, "button_back": S.css_color(_a("button_bg_color")), "button_ink": S.css_color(_a("button_text_color")), "label": _label(F.col("own_text"))})
    spacing, css = _spacing_of()
    rows = rows.withColumns({"spacing": spacing, "spacing_css": css, "align": S.text_align_class(F.element_at("r", "text_orientation"))})
    for kind, prefix, name in (("p", "body_", "align"), ("h", "header_", "textAlign")):
        style, coloured, css = _text_styles(prefix)
        classes = F.concat_ws(" ", F.nullif("align", F.lit("")), F.when(coloured, "has-text-color"))
        rows = rows.withColumns({f"{kind}_json": block_json(F.struct(F.when(F.col("align") != "", F.element_at("r", "text_orientation")).alias(name), style.alias("style"))), f"{kind}_attrs": _cat(F.when(classes != "", _cat(' class="', classes, '"')).otherwise(""), _style_attr(css))})
    return rows


def _text_styles(prefix: str) -> tuple[Column, Column, Column]:
    """(style struct or null, has it a colour, declarations) of the settings that start with prefix, around a text."""
    get = lambda name: F.element_at("r", prefix + name)
    color = S.css_color(get("text_color"))
    sizes = {"fontSize": ("font-size", S.css_length(get("font_size"))), "letterSpacing": ("letter-spacing", S.css_length(get("letter_spacing"))), "lineHeight": ("line-height", S.css_line_height(get("line_height")))}
    typography = F.when(F.concat(*[v for _, v in sizes.values()]) != "", F.struct(*[F.nullif(v, F.lit("")).alias(k) for k, (_, v) in sizes.items()]))
    style = F.when((color != "") | typography.isNotNull(), F.struct(F.when(color != "", F.struct(color.alias("text"))).alias("color"), typography.alias("typography")))
    return style, color != "", _declarations(("color", color), *sizes.values())


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def block_json(attrs: Column) -> Column:
    """A struct as block attributes: null fields left out, then the six replacements of the format, in its order."""
    text = F.to_json(attrs)
    for old, new in (("--", "\\u002d\\u002d"), ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ('\\"', "\\u0022"), ("\\\\", "\\u005c")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(_cat(" ", text), r"^ \{\}$", "")


def _open(name: str, attrs: Column | None = None) -> Column:
    return _cat(f"<!-- wp:{name}", block_json(attrs) if attrs is not None else "", " -->\n")


def _close(name: str) -> str:
    return f"\n<!-- /wp:{name} -->\n\n"


def block(name: str, html, attrs: Column | None = None) -> Column:
    return _cat(_open(name, attrs), html, _close(name))


def void_block(name: str, attrs: Column | None = None) -> Column:
    return _cat(f"<!-- wp:{name}", block_json(attrs) if attrs is not None else "", " /-->\n\n")


def _sides(box: Column) -> Column:
    """A box with null for sides that aren't set; null if none is."""
    some = F.array_contains(F.array(*[box[s] != "" for s in S.SIDES]), F.lit(True))
    return F.when(some, F.struct(*[F.nullif(box[s], F.lit("")).alias(s) for s in S.SIDES]))


def _declarations(*pairs: tuple[str, Column]) -> Column:
    """property:value for those that are set, joined by semicolons."""
    return F.array_join(F.filter(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", _cat(p + ":", v)) for p, v in pairs]), lambda x: x.isNotNull()), ";")


def _style_attr(css: Column) -> Column:
    return F.when(css == "", "").otherwise(_cat(' style="', css, '"'))


def _spacing() -> tuple[Column, Column]:
    return F.col("spacing"), F.col("spacing_css")


def _spacing_of() -> tuple[Column, Column]:
    """(style struct or null, declarations) of margin, then padding."""
    margin, padding = F.col("margin"), F.col("padding")
    m, p = _sides(margin), _sides(padding)
    css = _declarations(*[(f"margin-{s}", margin[s]) for s in S.SIDES], *[(f"padding-{s}", padding[s]) for s in S.SIDES])
    return F.when(m.isNotNull() | p.isNotNull(), F.struct(m.alias("margin"), p.alias("padding"))), css


def _wrapper() -> tuple[Column, Column, Column]:
    """(style struct or null, classes, declarations): border, background, margin, padding, in that order."""
    on = F.coalesce(_a("background_enable_color"), F.lit("on")) != "off"
    color = F.when(on, F.col("back")).otherwise("")
    border = {"color": F.col("border_color"), "style": F.col("border_style"), "width": F.col("border_width"), "radius": F.col("radius")}
    spacing, spacing_css = _spacing()
    has_border = F.concat(*border.values()) != ""
    style = F.when(has_border | (color != "") | spacing.isNotNull(), F.struct(
        F.when(has_border, F.struct(*[F.nullif(v, F.lit("")).alias(k) for k, v in border.items()])).alias("border"),
        F.when(color != "", F.struct(color.alias("background"))).alias("color"),
        spacing.alias("spacing"),
    ))
    classes = F.concat(F.when(border["color"] != "", " has-border-color").otherwise(""), F.when(color != "", " has-background").otherwise(""))
    css = F.concat_ws(";", *[F.nullif(x, F.lit("")) for x in (_declarations(*[(f"border-{k}", v) for k, v in border.items()], ("background-color", color)), spacing_css)])
    return style, classes, css


def _heading(level: int, name: str, centre: str = "") -> Column:
    """A heading of a text attribute; centre says whether the alignment stands before or after the level."""
    parts = [F.lit(level).alias("level"), *([F.lit("center").alias("textAlign")] if centre else [])]
    attrs = F.struct(*(parts[::-1] if centre == "before" else parts))
    return F.when(_given(_a(name)), block("heading", _cat(f"<h{level}", ' class="has-text-align-center"' if centre else "", ">", _t(name), f"</h{level}>"), attrs)).otherwise("")


def _centred(name: str) -> Column:
    return F.when(_given(_a(name)), block("paragraph", _cat('<p class="has-text-align-center">', _t(name), "</p>"), F.struct(F.lit("center").alias("align")))).otherwise("")


def _href(*names: str) -> Column:
    """The first of these URL attributes that the node has, escaped; # if it has none."""
    out = F.lit("#")
    for name in reversed(names):
        out = F.when(_a(name).isNotNull(), _e(name)).otherwise(out)
    return out


def _target() -> Column:
    return F.when(_a("url_new_window") == "on", ' target="_blank" rel="noopener noreferrer"').otherwise("")


def _link_button(text: str, *urls: str, outline: bool = False) -> Column:
    """One button of a row of buttons."""
    link = _cat('<div class="wp-block-button', " is-style-outline" if outline else "", '"><a class="wp-block-button__link wp-element-button" href="', _href(*urls), '">', _t(text), "</a></div>")
    return F.when(_given(_a(text)), block("button", link, F.struct(F.lit("is-style-outline").alias("className")) if outline else None)).otherwise("")


def _buttons(*buttons: Column, centred: bool = False) -> Column:
    """A row of these buttons, '' without any."""
    inner = F.concat(*buttons)
    layout = F.struct(F.struct(F.lit("flex").alias("type"), F.lit("center").alias("justifyContent")).alias("layout")) if centred else None
    return F.when(inner != "", block("buttons", _cat('<div class="wp-block-buttons', " is-content-justification-center" if centred else "", '">\n', inner, "\n</div>"), layout)).otherwise("")


def _image(src: str, alt: str, rounded: bool = False) -> Column:
    figure = _cat('<figure class="wp-block-image size-large', " is-style-rounded" if rounded else "", '"><img src="', _e(src), '" alt="', _t(alt), '"/></figure>')
    attrs = F.struct(F.lit("large").alias("sizeSlug"), F.lit("none").alias("linkDestination"), *([F.lit("is-style-rounded").alias("className")] if rounded else []))
    return F.when(_given(_a(src)), block("image", figure, attrs)).otherwise("")


Pieces = tuple[Column, Column]


def _group(before: Column | str = "", after: Column | str = "") -> Pieces:
    return _cat(_open("group"), '<div class="wp-block-group">\n', before), _cat(after, "\n</div>", _close("group"))


def _spaced_group(inner: Column | str = "") -> Pieces:
    spacing, css = _spacing()
    style = F.when(spacing.isNotNull(), F.struct(spacing.alias("spacing")))
    return _cat(_open("group", F.struct(style.alias("style"))), '<div class="wp-block-group"', _style_attr(css), ">\n", inner), _cat("\n</div>", _close("group"))


def _if(shown: Column, pieces: Pieces) -> Pieces:
    return F.when(shown, pieces[0]).otherwise(""), F.when(shown, pieces[1]).otherwise("")


def _leaf(markup: Column) -> Pieces:
    return markup, F.lit("")


def _has_children() -> Column:
    return F.col("last_id") > F.col("node_id")


def _section(_: Target) -> Pieces:
    style, classes, css = _wrapper()
    layout = F.struct(F.when(_a("fullwidth") == "on", "full").otherwise("constrained").alias("type"))
    return _cat(_open("group", F.struct(style.alias("style"), layout.alias("layout"))), '<div class="wp-block-group', classes, '"', _style_attr(css), ">\n"), _cat("\n</div>", _close("group"))


def _row(_: Target) -> Pieces:
    style, classes, css = _wrapper()
    return _if(F.col("columns") > 0, (_cat(_open("columns", F.struct(style.alias("style"))), '<div class="wp-block-columns', classes, '"', _style_attr(css), ">\n"), _cat("\n</div>", _close("columns"))))


def _column(_: Target) -> Pieces:
    style, classes, css = _wrapper()
    width = F.col("width")
    css = F.concat_ws(";", F.nullif(css, F.lit("")), F.when(width != "", _cat("flex-basis:", width)))
    return _cat(_open("column", F.struct(F.nullif(width, F.lit("")).alias("width"), style.alias("style"))), '<div class="wp-block-column', classes, '"', _style_attr(css), ">\n"), _cat("\n</div>", _close("column"))


def _text(_: Target) -> Pieces:
    return _if((F.col("spacing_css") != "") & _has_children(), _spaced_group())


def _code(_: Target) -> Pieces:
    return _leaf(F.when(F.col("own_text") != "", block("html", F.col("own_text"))).otherwise(""))


def _picture(_: Target) -> Pieces:
    src, link = _u("src"), _u("url")
    align = S.allowed_value(_a("align"), ("left", "center", "right", "wide", "full"))
    spacing, css = _spacing()
    attrs = F.struct(F.lit("large").alias("sizeSlug"), F.when(link != "", "custom").otherwise("none").alias("linkDestination"), src.alias("url"), F.coalesce(_a("alt"), F.lit("")).alias("alt"), F.col("image_id").alias("id"), F.nullif(link, F.lit("")).alias("href"), F.nullif(align, F.lit("")).alias("align"), F.when(spacing.isNotNull(), F.struct(spacing.alias("spacing"))).alias("style"))
    known = F.when(F.col("image_id").isNotNull(), _cat(' class="wp-image-', F.col("image_id").cast("string"), '"')).otherwise("")
    img = _cat('<img src="', _e("src"), '" alt="', _t("alt"), '"', known, "/>")
    img = F.when(link != "", _cat('<a href="', _e("url"), '"', _target(), ">", img, "</a>")).otherwise(img)
    caption = F.btrim(F.regexp_replace("own_text", r"(?is)</?(?!(?:a|em|strong|br)\b)[a-z][^>]*>", ""), F.lit(S.BLANKS))
    figure = _cat('<figure class="wp-block-image size-large', F.when(align != "", _cat(" align", align)).otherwise(""), '"', _style_attr(css), ">", img, F.when(_given(caption), _cat('<figcaption class="wp-element-caption">', caption, "</figcaption>")).otherwise(""), "</figure>")
    return _leaf(F.when(src != "", block("image", figure, attrs)).otherwise(""))


def _embed_block(host: Column, url: Column) -> Column:
    html = _cat('<figure class="wp-block-embed is-type-video is-provider-', host["provider"], " wp-block-embed-", host["provider"], '"><div class="wp-block-embed__wrapper">\n', S.escape_text(url), "\n</div></figure>")
    return block("embed", html, F.struct(url.alias("url"), F.lit("video").alias("type"), host["provider"].alias("providerNameSlug")))


def _element_src(text: Column, element: str) -> Column:
    return F.regexp_extract(text, rf"""(?i)<{element}\b[^>]*\bsrc=["']([^"']+)["']""", 1)


def _embed_tag(text: Column) -> Column:
    """A media element as a block: an embed on a known video host, a video with a safe source, else html."""

    def frame(host: Column) -> Column:
        return F.when(host["watch"] != "", _embed_block(host, host["watch"])).otherwise(block("html", text))

    def video(src: Column) -> Column:
        plain = block("video", _cat('<figure class="wp-block-video"><video controls src="', S.escape_text(src), '"></video></figure>'), F.struct(src.alias("src")))
        return F.when(src != "", plain).otherwise(block("html", text))

    return F.when(_element_src(text, "iframe") != "", once(S.video_provider(_element_src(text, "iframe")), frame)).otherwise(once(S.safe_url(_element_src(text, "video")), video))


def _video(_: Target) -> Pieces:
    src, host = F.col("video_src"), F.col("host")
    url = F.when(host["is_embed"] & (host["watch"] != ""), host["watch"]).otherwise(src)
    spacing, css = _spacing()
    plain = block("video", _cat("<figure", _style_attr(css), ' class="wp-block-video"><video controls src="', S.escape_text(src), '"></video></figure>'), F.struct(src.alias("src"), F.when(spacing.isNotNull(), F.struct(spacing.alias("spacing"))).alias("style")))
    return _leaf(F.when(F.col("video_frame"), _embed_tag(F.col("own_text"))).when(src == "", "").when(host["provider"] != "", _embed_block(host, url)).otherwise(plain))


def _audio(_: Target) -> Pieces:
    src = _u("audio")
    artist = F.when(_given(_a("artist_name")), block("paragraph", _cat("<p>", _t("artist_name"), "</p>"))).otherwise("")
    about = F.concat(F.when(_u("image_url") != "", _image("image_url", "title")).otherwise(""), _heading(4, "title"), artist)
    spacing, css = _spacing()

    def made(about: Column) -> Column:
        style = F.when((about == "") & spacing.isNotNull(), F.struct(spacing.alias("spacing")))
        sound = block("audio", _cat("<figure", F.when(about == "", _style_attr(css)).otherwise(""), ' class="wp-block-audio"><audio controls src="', _e("audio"), '"></audio></figure>'), F.struct(src.alias("src"), style.alias("style")))
        opening, closing = _spaced_group()
        return _cat(F.when(about == "", "").otherwise(opening), about, sound, F.when(about == "", "").otherwise(closing))

    return _leaf(F.when(src == "", "").otherwise(once(about, made)))


def _slider_gallery() -> Column:
    layout = F.lower(F.coalesce(_a("gallery_layout"), _a("layout"), _a("type"), F.lit("")))
    return F.coalesce(_a("fullwidth") == "on", F.lit(False)) | layout.isin("slider", "carousel")


def _gallery(_: Target) -> Pieces:
    columns = F.greatest(F.lit(1), F.least(F.lit(8), _int(F.coalesce(_a("gallery_columns"), _a("columns_number")), "3")))
    link = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("off", "none", "lightbox", "media", "file", "media", "attachment", "attachment")]), F.coalesce(_a("gallery_link"), F.lit("lightbox"))), F.lit("none"))
    captioned = F.coalesce(_a("show_title_and_caption"), F.lit("")) != "off"

    def picture(x: Column) -> Column:
        caption = F.when(captioned & (F.coalesce(x["caption"], F.lit("")) != ""), _cat('<figcaption class="wp-element-caption">', S.escape_text(x["caption"]), "</figcaption>")).otherwise("")
        img = _cat('<img src="', S.escape_text(x["url"]), '" alt="', S.escape_text(x["alt"]), '" class="wp-image-', x["image"].cast("string"), '"/>')
        return block("image", _cat('<figure class="wp-block-image size-large">', img, caption, "</figure>"), F.struct(x["image"].alias("id"), F.lit("large").alias("sizeSlug"), link.alias("linkDestination"), x["url"].alias("url"), F.coalesce(x["alt"], F.lit("")).alias("alt")))

    images = F.array_join(F.transform(F.filter("gallery", lambda x: x["url"].isNotNull()), picture), "")
    slider = _slider_gallery()
    spacing, css = _spacing()
    figure = _cat('<figure class="wp-block-gallery has-nested-images columns-', columns.cast("string"), " is-cropped", F.when(slider, " d2g-gallery-slider").otherwise(""), '"', _style_attr(css), ">\n", F.coalesce(images, F.lit("")), "</figure>")
    attrs = F.struct(columns.alias("columns"), link.alias("linkTo"), F.lit(True).alias("imageCrop"), F.when(slider, "d2g-gallery-slider").alias("className"), F.when(spacing.isNotNull(), F.struct(spacing.alias("spacing"))).alias("style"))
    none = block("paragraph", "<p>[Gallery — no images specified]</p>")
    return _leaf(F.when(F.coalesce(_a("gallery_ids"), F.lit("")) == "", none).otherwise(block("gallery", figure, attrs)))


def _button_module(_: Target) -> Pieces:
    align, back, ink = F.col("button_align"), F.col("button_back"), F.col("button_ink")
    color = F.when((back != "") | (ink != ""), F.struct(F.struct(F.nullif(back, F.lit("")).alias("background"), F.nullif(ink, F.lit("")).alias("text")).alias("color")))
    classes = F.concat(F.when(back != "", " has-background").otherwise(""), F.when(ink != "", " has-text-color").otherwise(""))
    link = _cat('<div class="wp-block-button"><a class="wp-block-button__link wp-element-button', classes, '"', _style_attr(_declarations(("background-color", back), ("color", ink))), ' href="', _href("button_url"), '"', _target(), ">", _t("button_text", "Click Here"), "</a></div>")
    spacing, css = _spacing()
    attrs = F.struct(F.when(align != "", F.struct(F.lit("flex").alias("type"), align.alias("justifyContent"))).alias("layout"), F.when(spacing.isNotNull(), F.struct(spacing.alias("spacing"))).alias("style"))
    return _leaf(block("buttons", _cat('<div class="wp-block-buttons', F.when(align != "", _cat(" is-content-justification-", align)).otherwise(""), '"', _style_attr(css), ">\n", block("button", link, F.struct(color.alias("style"))), "\n</div>"), attrs))


def _blurb(_: Target) -> Pieces:
    level = _int(F.replace(_a("header_level"), F.lit("h"), F.lit("")), "4")
    level = F.when(level.between(1, 6), level).otherwise(4)
    linked = _given(_a("url"))
    in_link = lambda html: F.when(linked, _cat('<a href="', _e("url"), '"', _target(), ">", html, "</a>")).otherwise(html)
    figure = _cat('<figure class="wp-block-image size-large">', in_link(_cat('<img src="', _e("image"), '" alt="', _t("title"), '"/>')), "</figure>")
    image = F.when(_given(_a("image")), block("image", figure, F.struct(F.lit("large").alias("sizeSlug"), F.when(linked, "custom").otherwise("none").alias("linkDestination")))).otherwise("")
    heading = F.when(_given(_a("title")), block("heading", _cat("<h", level.cast("string"), ">", in_link(_t("title")), "</h", level.cast("string"), ">"), F.struct(level.alias("level")))).otherwise("")
    return _group(F.concat(image, heading))


def _cta(_: Target) -> Pieces:
    back = F.col("back")
    style = F.when(back != "", F.struct(F.struct(back.alias("background")).alias("color")))
    return _cat(_open("group", F.struct(style.alias("style"))), '<div class="wp-block-group', F.when(back != "", " has-background").otherwise(""), '"', _style_attr(_declarations(("background-color", back))), ">\n", _heading(2, "title")), _cat(_buttons(_link_button("button_text", "button_url")), "\n</div>", _close("group"))


def _divider(_: Target) -> Pieces:
    color = F.col("color")
    spacing, css = _spacing()
    css = F.concat_ws(";", F.nullif(css, F.lit("")), F.when(color != "", _cat("background-color:", color, ";color:", color)))
    style = F.when((color != "") | spacing.isNotNull(), F.struct(F.when(color != "", F.struct(color.alias("background"))).alias("color"), spacing.alias("spacing")))
    classes = F.when(color != "", " has-text-color has-alpha-channel-opacity has-background").otherwise(" has-alpha-channel-opacity")
    return _leaf(block("separator", _cat('<hr class="wp-block-separator', classes, '"', _style_attr(css), "/>"), F.struct(style.alias("style"))))


def _cover_or_group(before: Column, after: Column, target: Target, *images: str) -> Pieces:
    """A cover over the first of these URL attributes that the node has, or a group. Newer hosts want the image first."""
    raw, url, escaped, overlay = F.lit(""), F.lit(""), F.lit(""), F.col("back")
    for name in reversed(images):
        here = _a(name).isNotNull()
        raw, url, escaped = F.when(here, _a(name)).otherwise(raw), F.when(here, _u(name)).otherwise(url), F.when(here, _e(name)).otherwise(escaped)
    attrs = F.struct(url.alias("url"), F.nullif(overlay, F.lit("")).alias("customOverlayColor"))
    image = _cat('<img class="wp-block-cover__image-background" alt="" src="', escaped, '" data-object-fit="cover"/>')
    dim = _cat('<span aria-hidden="true" class="wp-block-cover__background has-background-dim-100 has-background-dim"', _style_attr(_declarations(("background-color", overlay))), "></span>")
    first = _cat(_open("cover", attrs), '<div class="wp-block-cover">', F.when(target.at_least(6, 8), _cat(image, dim)).otherwise(_cat(dim, image)), '<div class="wp-block-cover__inner-container">\n')
    plain = _group()
    return _cat(F.when(_given(raw), first).otherwise(plain[0]), before), _cat(after, F.when(_given(raw), _cat("\n</div></div>", _close("cover"))).otherwise(plain[1]))


def _header(target: Target) -> Pieces:
    subhead = F.when(_given(_a("subhead")), block("paragraph", _cat('<p class="has-text-align-center has-large-font-size">', _t("subhead"), "</p>"), F.struct(F.lit("center").alias("align"), F.lit("large").alias("fontSize")))).otherwise("")
    buttons = _buttons(_link_button("button_one_text", "button_one_url"), _link_button("button_two_text", "button_two_url", outline=True), centred=True)
    return _cover_or_group(F.concat(_heading(1, "title", "after"), subhead), buttons, target, "background_image")


def _slide(target: Target) -> Pieces:
    return _cover_or_group(_heading(2, "heading"), _buttons(_link_button("button_text", "button_link", "link")), target, "background_image", "image")


def _testimonial(_: Target) -> Pieces:
    company = F.when(_given(_a("url")), _cat('<a href="', _e("url"), '">', _t("company_name"), "</a>")).otherwise(_t("company_name"))
    cite = F.concat_ws(", ", F.when(_given(_a("author")), _cat("<strong>", _t("author"), "</strong>")), F.when(_given(_a("company_name")), company))
    body = F.when(~_has_children() & (cite != ""), block("paragraph", "<p></p>")).otherwise("")
    quoted = _has_children() | (cite != "")
    return _group(F.concat(_image("portrait_url", "author", True), F.when(quoted, _cat(_open("quote"), '<blockquote class="wp-block-quote">\n', body)).otherwise("")), F.when(quoted, _cat(F.when(cite != "", _cat("<cite>", cite, "</cite>")).otherwise(""), "</blockquote>", _close("quote"))).otherwise(""))


def _social_link(url: Column, service: Column) -> Column:
    return F.when(_given(service) & (url != ""), void_block("social-link", F.struct(url.alias("url"), service.alias("service")))).otherwise("")


_SOCIAL_OPEN, _SOCIAL_CLOSE = '<ul class="wp-block-social-links">\n', "</ul>"


def _team_member(_: Target) -> Pieces:
    position = F.when(_given(_a("position")), block("paragraph", _cat('<p class="has-small-font-size"><em>', _t("position"), "</em></p>"), F.struct(F.lit("small").alias("fontSize")))).otherwise("")

    def link(n: Column) -> Column:
        name = F.concat(n, F.lit("_url"))
        return F.when(_given(F.element_at("a", name)), _social_link(F.coalesce(F.element_at("urls", name), F.lit("")), n)).otherwise("")

    links = F.array_join(F.transform(F.array(*[F.lit(n) for n in S.SOCIAL_NETWORKS]), link), "")
    social = once(links, lambda x: F.when(x != "", block("social-links", _cat(_SOCIAL_OPEN, x, _SOCIAL_CLOSE))).otherwise(""))
    return _group(F.concat(_image("image_url", "name"), _heading(3, "name"), position), social)


def _toggle(target: Target) -> Pieces:
    """Details, whose title is an attribute as well on the first hosts that had it; where there are none, a headed group."""
    title = _t("title", "Toggle")
    headed = _group(block("heading", _cat("<h3>", title, "</h3>"), F.struct(F.lit(3).alias("level"))))
    is_open = _a("open") == "on"
    attrs = F.struct(F.when(is_open, F.lit(True)).alias("showContent"), F.when(~target.at_least(6, 4), title).alias("summary"))
    opening = _cat(_open("details", attrs), '<details class="wp-block-details"', F.when(is_open, " open").otherwise(""), "><summary>", title, "</summary>", F.when(_has_children(), "\n").otherwise(""))
    here = target.has("details")
    return F.when(here, opening).otherwise(headed[0]), F.when(here, _cat("</details>", _close("details"))).otherwise(headed[1])


def _tab(_: Target) -> Pieces:
    return _group(block("heading", _cat("<h3>", _t("title", "Tab"), "</h3>"), F.struct(F.lit(3).alias("level"))))


def _counter(_: Target) -> Pieces:
    label = F.coalesce(F.nullif("label", F.lit("")), _a("title"), F.lit(""))
    return _leaf(block("paragraph", _cat("<p><strong>", S.escape_text(label), "</strong>: ", _t("percent", "0"), "%</p>")))


def _number(_: Target) -> Pieces:
    shown = F.concat(_t("number", "0"), F.when(F.coalesce(_a("percent_sign"), F.lit("on")) == "on", "%").otherwise(""))
    heading = block("heading", _cat('<h2 class="has-text-align-center">', shown, "</h2>"), F.struct(F.lit("center").alias("textAlign"), F.lit(2).alias("level")))
    return _leaf(block("group", _cat('<div class="wp-block-group">\n', heading, _centred("title"), "\n</div>")))


def _pricing_table(_: Target) -> Pieces:
    price = F.when(_given(_a("sum")), block("heading", _cat('<h2 class="has-text-align-center">', _t("currency", "$"), _t("sum"), F.when(_given(_a("per")), _cat("<small>/", _t("per"), "</small>")).otherwise(""), "</h2>"), F.struct(F.lit("center").alias("textAlign"), F.lit(2).alias("level")))).otherwise("")
    return _cat(_open("column"), '<div class="wp-block-column">\n', _heading(3, "title", "before"), _centred("subtitle"), price), _cat(_buttons(_link_button("button_text", "button_url"), centred=True), "\n</div>", _close("column"))


def _starts() -> Column:
    return ~F.coalesce(F.col("previous_tag") == F.col("tag"), F.lit(False))


def _ends() -> Column:
    return ~F.coalesce(F.col("next_tag") == F.col("tag"), F.lit(False))


def _pricing_item(_: Target) -> Pieces:
    """A run of items is one list: its first opens it, its last closes it."""
    text, off = F.col("label"), F.coalesce(_a("available") == "off", F.lit(False))
    label = _cat(F.when(off, "<s>").otherwise(""), S.escape_text(text), F.when(off, "</s>").otherwise(""))
    item = F.when(text != "", block("list-item", _cat("<li>", label, "</li>"))).otherwise("")
    return _if(F.col("run_shows"), (_cat(F.when(_starts(), _cat(_open("list"), '<ul class="wp-block-list">\n')).otherwise(""), item), F.when(_ends(), _cat("</ul>", _close("list"))).otherwise("")))


def _map(_: Target) -> Pieces:
    """One html block of the address and a paragraph a pin."""
    place = F.when(_given(_a("address")), _t("address")).when(_given(_a("address_lat")) & _given(_a("address_lng")), _cat(_t("address_lat"), ", ", _t("address_lng"))).otherwise("")
    first, last = _group(_cat(_open("html"), F.when(place != "", _cat("<p><strong>Map:</strong> ", place, "</p>")).otherwise("")), _close("html"))
    return _if((place != "") | (F.col("columns") > 0), (first, last))


def _pin(_: Target) -> Pieces:
    about = F.when(F.col("own_text") != "", _cat(": ", F.col("own_text"))).otherwise("")
    return _leaf(F.when(_given(_a("title")), _cat("<p><strong>", _t("title"), "</strong>", about, "</p>")).otherwise(""))


def _categories(use: Callable[[Column], Column]) -> Column:
    """The listed categories, null without any."""
    return F.when(_given(_a("include_categories")), F.transform(F.split(_a("include_categories"), ","), lambda x: use(_int(x, "0"))))


def _blog(_: Target) -> Pieces:
    return _leaf(void_block("latest-posts", F.struct(_int(_a("posts_number"), "10").alias("postsToShow"), _categories(lambda i: F.struct(i.alias("id"))).alias("categories"))))


def _portfolio(target: Target) -> Pieces:
    listed = _categories(lambda i: i)
    kind, taxonomy = target.portfolio()
    query = F.struct(kind.alias("postType"), _int(_a("posts_number"), "4").alias("perPage"), F.lit("desc").alias("order"), F.lit("date").alias("orderBy"), F.when(listed.isNotNull(), F.create_map(taxonomy, listed)).alias("taxQuery"))
    inner = F.concat(void_block("post-featured-image"), void_block("post-title"), F.when(_a("fullwidth") == "on", "").otherwise(void_block("post-excerpt")))
    return _leaf(block("query", _cat('<div class="wp-block-query">\n', block("post-template", inner), "</div>"), F.struct(query.alias("query"))))


#: What kinds of form fields are called.
FIELD_KINDS = {"input": "text", "email": "e-mail address", "text": "longer text", "select": "list to choose from", "radio": "single choice", "checkbox": "choices"}


def _field(_: Target) -> Pieces:
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FIELD_KINDS.items() for x in pair]), F.coalesce(_a("field_type"), F.lit("input"))), _t("field_type"))
    title = F.coalesce(F.element_at("texts", "field_title"), F.element_at("texts", "field_id"), F.lit("Field"))
    required = F.when(F.coalesce(_a("required_mark"), F.lit("on")) == "on", " (required)").otherwise("")
    options = F.when(_given(_a("field_options")), _cat("<br/>", F.replace(_t("field_options"), F.lit("|"), F.lit(", ")))).otherwise("")
    return _leaf(block("list-item", _cat("<li>", title, " — ", kind, required, options, "</li>")))


def _form(_: Target) -> Pieces:
    fields = F.col("columns") > 0
    sent = F.when(_given(_a("email")), _cat(" that was sent to ", _t("email"))).otherwise("")
    intro = block("paragraph", _cat("<p><em>This was a contact form", sent, ". Rebuild it from these fields.</em></p>"))
    submit = block("paragraph", _cat("<p><em>Its button said: ", _t("submit_button_text", "Send"), "</em></p>"))
    return _group(F.concat(_heading(3, "title"), intro, F.when(fields, _cat(_open("list"), '<ul class="wp-block-list">\n')).otherwise("")), F.concat(F.when(fields, _cat("</ul>", _close("list"))).otherwise(""), submit))


def _signup(_: Target) -> Pieces:
    title = F.when(F.coalesce(_a("title"), F.lit("Subscribe")).isin("", "0"), "").otherwise(block("heading", _cat("<h3>", _t("title", "Subscribe"), "</h3>"), F.struct(F.lit(3).alias("level"))))
    about = F.when(_given(_a("description")), block("paragraph", _cat("<p>", _t("description"), "</p>"))).otherwise("")
    first, last = _group(F.concat(title, about, block("paragraph", "<p><em>[Sign-up form: add the provider's block here.]</em></p>")))
    return _leaf(_cat(first, last))


def _network(_: Target) -> Pieces:
    """A run of networks in their module is one block; of equal ones the last counts, at the place of the first. One that
    stands elsewhere is a link by itself."""
    link = F.when(F.col("first_same"), _social_link(S.safe_url(F.col("last_url")), _a("social_network"))).otherwise("")
    run = _if(F.col("run_shows"), (_cat(F.when(_starts(), _cat(_open("social-links"), _SOCIAL_OPEN)).otherwise(""), link), F.when(_ends(), _cat(_SOCIAL_CLOSE, _close("social-links"))).otherwise("")))
    inside = _in("social_media_follow")
    return F.when(inside, run[0]).otherwise(_social_link(S.safe_url(F.coalesce(_a("url"), F.lit("#"))), _a("social_network"))), F.when(inside, run[1]).otherwise("")


def _sidebar(_: Target) -> Pieces:
    return _leaf(block("paragraph", _cat("<p><em>[Sidebar: ", _t("area", "sidebar-1"), "]</em></p>")))


def _shop(_: Target) -> Pieces:
    return _leaf(block("paragraph", _cat("<p><em>[Shop: ", _t("type", "recent"), ", ", _t("columns_number", "4"), " columns, ", _t("posts_number", "4"), " products]</em></p>")))


def _through(_: Target) -> Pieces:
    return F.lit(""), F.lit("")


def _void(name: str) -> Callable[[Target], Pieces]:
    return lambda _: _leaf(void_block(name))


def _plain_group(_: Target) -> Pieces:
    return _group()


#: Which function renders a module: the dispatch table.
DISPATCH: dict[str, Callable[[Target], Pieces]] = {
    "section": _section, "row": _row, "row_inner": _row, "column": _column, "column_inner": _column, "text": _text,
    "code": _code, "fullwidth_code": _code, "image": _picture, "fullwidth_image": _picture, "video": _video, "video_slider": lambda _: _if(_has_children(), _spaced_group()), "audio": _audio, "gallery": _gallery,
    "map": _map, "fullwidth_map": _map, "button": _button_module, "blurb": _blurb, "cta": _cta, "divider": _divider, "fullwidth_header": _header, "testimonial": _testimonial, "team_member": _team_member,
    "social_media_follow": _through, "social_media_follow_network": _network, "accordion": _plain_group, "toggle": _toggle, "tabs": _plain_group, "tab": _tab,
    "slider": _plain_group, "fullwidth_slider": _plain_group, "post_slider": _plain_group, "fullwidth_post_slider": _plain_group, "slide": _slide, "counters": _plain_group, "counter": _counter, "number_counter": _number, "circle_counter": _number,
    "pricing_tables": lambda _: (_cat(_open("columns"), '<div class="wp-block-columns">\n'), _cat("\n</div>", _close("columns"))), "pricing_table": _pricing_table, "pricing_item": _pricing_item,
    "blog": _blog, "portfolio": _portfolio, "filterable_portfolio": _portfolio, "fullwidth_portfolio": _portfolio, "menu": _void("navigation"), "fullwidth_menu": _void("navigation"),
    "search": lambda _: _leaf(void_block("search", F.struct(F.when(_given(_a("placeholder")), _a("placeholder")).alias("placeholder")))), "post_title": _void("post-title"), "comments": lambda _: _leaf(block("comments", '<div class="wp-block-comments"></div>')), "login": _void("loginout"),
    "sidebar": _sidebar, "shop": _shop, "contact_form": _form, "signup": _signup,
}
#: Modules that only their parents draw; anywhere else they are unknown.
PARTS: dict[str, tuple[tuple[str, ...], Callable[[Target], Pieces]]] = {"contact_field": (("contact_form",), _field), "map_pin": (MAPS, _pin), "video_slider_item": (("video_slider",), _video)}


def _known() -> Column:
    parts = F.lit(False)
    for module, (parents, _) in PARTS.items():
        parts = parts | _is(module) & _in(*parents)
    return _is(*DISPATCH) | parts


def text_blocks() -> Column:
    """The blocks of a text node's HTML, written out; paragraphs and headings carry what is set around the text."""

    def written(b: Column) -> Column:
        html, ordered, plain = b["html"], b["level"] == 1, b["level"] >= PLAIN
        level, rest = (b["level"] % PLAIN).cast("string"), F.when(plain, "").otherwise(F.col("h_json"))
        heading = _cat('<!-- wp:heading {"level":', level, F.when(rest == "", "}").otherwise(_cat(",", F.substring(rest, F.lit(3), F.length(rest)))), " -->\n<h", level, F.when(plain, "").otherwise(F.col("h_attrs")), ">", html, "</h", level, ">", _close("heading"))
        list_tag = F.when(ordered, "ol").otherwise("ul")
        return (
            F.when(b["kind"] == "p", _cat("<!-- wp:paragraph", F.when(plain, "").otherwise(F.col("p_json")), " -->\n<p", F.when(plain, "").otherwise(F.col("p_attrs")), ">", html, "</p>", _close("paragraph")))
            .when(b["kind"] == "h", heading)
            .when(b["kind"] == "html", block("html", html))
            .when(b["kind"] == "embed", _embed_tag(html))
            .when(b["kind"] == "hr", block("separator", '<hr class="wp-block-separator has-alpha-channel-opacity"/>'))
            .when(b["kind"] == "pre", block("preformatted", _cat('<pre class="wp-block-preformatted">', html, "</pre>")))
            .when(b["kind"] == "table", block("table", _cat('<figure class="wp-block-table"><table>', html, "</table></figure>"), F.struct(F.lit(False).alias("hasFixedLayout"))))
            .when(b["kind"] == "list", _cat("<!-- wp:list", F.when(ordered, ' {"ordered":true}').otherwise(""), " -->\n<", list_tag, ' class="wp-block-list">\n'))
            .when(b["kind"] == "/list", _cat("</", list_tag, ">", _close("list")))
            .when(b["kind"] == "item", _cat("<!-- wp:list-item -->\n<li>", html))
            .when(b["kind"] == "nest", "\n")
            .when(b["kind"] == "/item", _cat("</li>", _close("list-item")))
            .when(b["kind"] == "quote", '<!-- wp:quote -->\n<blockquote class="wp-block-quote">\n')
            .when(b["kind"] == "/quote", _cat(F.when(html != "", _cat("<cite>", html, "</cite>")).otherwise(""), "</blockquote>", _close("quote")))
            .otherwise("")
        )

    return F.array_join(F.transform("blocks", written), "")


def drawn(nodes: DataFrame) -> DataFrame:
    """The nodes with no more text than rendering writes out: the blocks of text nodes, and the own text of modules that draw it
    themselves, as they swallow their subtree or have none. A text stands once, not again in all that it lies in."""
    own = (F.col("tag") != TEXT) & (_is(*SWALLOWING, *PARTS) | ~_has_children())
    return nodes.drop("content").withColumn("own_text", F.when(own, F.col("own_text")).otherwise(""))


def visible(nodes: DataFrame) -> DataFrame:
    """The nodes (with LOOSE columns) that are rendered, with their attributes as a map and a video's source: none below a
    module that swallows its subtree, and in maps and forms only what they draw."""
    before = Window.partitionBy("id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("a", F.map_from_entries("attrs"))
    video = _is("video", "video_slider_item")
    source = F.coalesce(F.nullif(S.safe_url(_a("src")), F.lit("")), S.safe_url(_a("src_webm")))
    rows = rows.withColumn("video_src", F.when(video, source).otherwise(""))
    framed = video & (F.col("video_src") == "") & (_element_src(F.col("own_text"), "iframe") != "")
    bare = video & (F.col("video_src") == "") & ~framed & F.col("own_text").rlike("^https?://")
    rows = rows.withColumns({"video_frame": framed, "video_src": F.when(bare, S.safe_url(F.col("own_text"))).otherwise(F.col("video_src"))})
    foreign = _in(*MAPS) & ~_is("map_pin") | _in("contact_form") & ~_is("contact_field")
    shown = _is("video_slider_item") & _in("video_slider") & ((F.col("video_src") != "") | F.col("video_frame"))
    swallows = _is(*[m for m in SWALLOWING if m not in PARTS]) | shown | _is("contact_field") & _in("contact_form") | _is("map_pin") & _in(*MAPS)
    reach = F.max(F.when(swallows | foreign, F.col("last_id"))).over(before)
    return rows.withColumn("_reach", F.coalesce(reach, F.lit(-1))).where((F.col("node_id") > F.col("_reach")) & ~foreign).drop("_reach")


def _shows() -> Column:
    """Does a text node come out as anything?"""
    return F.exists("blocks", lambda b: ~b["kind"].isin(*HTML_NOTES))


_WRITTEN: dict[tuple[object, Target | OwnTarget], tuple[Column, Column]] = {}


def _written(target: Target | OwnTarget) -> Pieces:
    """Every node's opening and closing piece, by its tag. The expressions are large and always the same, so they are built
    once a session and target."""
    key = (SparkContext._gateway, target)
    if key in _WRITTEN:
        return _WRITTEN[key]
    opening = F.when(F.col("tag") == TEXT, text_blocks())
    closing = F.when(F.col("tag") == TEXT, "")
    # one branch a function: modules that look alike share theirs
    alike: dict[Callable[[Target], Pieces], Column] = {}
    for module, render in DISPATCH.items():
        alike[render] = alike[render] | _is(module) if render in alike else _is(module)
    for module, (parents, render) in PARTS.items():
        here = _is(module) & _in(*parents)
        alike[render] = alike[render] | here if render in alike else here
    for render, here in alike.items():
        first, last = render(target)
        opening, closing = opening.when(here, first), closing.when(here, last)
    opening = opening.when(~_has_children() & (F.col("own_text") != ""), block("html", F.col("own_text"))).otherwise("")
    _WRITTEN[key] = opening, closing.otherwise("")
    return _WRITTEN[key]


def pieces(nodes: DataFrame, attachments: DataFrame | None = None, base_url: str = "", target: Target = Target(), targets: DataFrame | None = None) -> DataFrame:
    """id, module, at, side, inner, piece: the opening (side 0) and closing (side 1) markup of every node (of a node table with
    LOOSE columns), with its place, and whether the node is a module. `targets` (id, target) gives each document its own."""
    rows = visible(drawn(nodes)).where((F.col("tag") != TEXT) | _shows())
    siblings = Window.partitionBy("id", "parent_id").orderBy("ordinal")
    rows = rows.withColumns({"previous_tag": F.lag("tag").over(siblings), "next_tag": F.lead("tag").over(siblings)})
    rows = rows.withColumn("run", F.sum(_starts().cast("int")).over(siblings))
    same = Window.partitionBy("id", "parent_id", "run", F.coalesce(_a("social_network"), F.lit(""))).orderBy("ordinal")
    rows = rows.withColumns({"first_same": F.row_number().over(same) == 1, "last_url": F.last(F.coalesce(_a("url"), F.lit("#"))).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    shown = F.when(_is("pricing_item"), _label(F.col("own_text")) != "").when(_is("social_media_follow_network"), _given(_a("social_network")) & (S.safe_url(F.col("last_url")) != "")).otherwise(False)
    rows = rows.withColumn("run_shows", F.max(shown).over(Window.partitionBy("id", "parent_id", "run")))
    if attachments is not None:
        # by document, as the rows lie already: a join by node would move them all again
        media = _media(nodes, attachments, base_url).groupBy("id", "node_id").agg(F.first("gallery", ignorenulls=True).alias("gallery"), F.max("image_id").alias("image_id"))
        media = media.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", F.struct("gallery", "image_id")))).alias("media"))
        rows = rows.join(media, "id", "left").withColumn("media", F.element_at("media", F.col("node_id")))
        rows = rows.withColumns({"gallery": F.col("media.gallery"), "image_id": F.col("media.image_id")}).drop("media")
    else:
        rows = rows.withColumns({"gallery": F.lit(None).cast(_GALLERY), "image_id": F.lit(None).cast("long")})
    rows = _prepared(rows)
    opening, closing = _written(target if targets is None else OwnTarget())
    if targets is not None:
        rows = rows.join(targets.select("id", "target"), "id", "left").withColumn("target", F.coalesce("target", target.row()))
    sides = F.array(
        F.struct(F.col("node_id").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("inner"), opening.alias("piece")),
        F.struct(F.col("last_id").alias("at"), F.lit(1).alias("side"), (-F.col("depth")).alias("inner"), closing.alias("piece")),
    )
    return rows.select("id", (F.col("tag") != TEXT).alias("module"), F.explode(sides).alias("s")).select("id", "module", "s.*")


_GALLERY = "array<struct<place:int,image:long,url:string,alt:string,caption:string>>"


def gallery_urls(nodes: DataFrame, attachments: DataFrame, base_url: str) -> DataFrame:
    """id, node_id, gallery: each gallery's images in order with their URLs (null where gone), alt texts and captions (where
    `attachments` has columns of these names), from one join for all."""
    from foliant.operators.inventory import resolve_attachments

    listed = nodes.where(F.col("tag") == PREFIX + "gallery").select(F.col("id").alias("doc"), "node_id", F.explode(_listed(F.element_at(F.map_from_entries("attrs"), "gallery_ids"))).alias("x")).select("doc", "node_id", "x.place", F.col("x.image").alias("id"))
    for name in ("alt", "caption"):
        if name not in attachments.columns:
            attachments = attachments.withColumn(name, F.lit(None).cast("string"))
    found = resolve_attachments(listed, attachments, base_url, "alt", "caption")
    return found.groupBy(F.col("doc").alias("id"), "node_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("image"), _stored_url().alias("url"), "alt", "caption"))).alias("gallery"))


def _listed(ids: Column) -> Column:
    """array<struct<place,image>> of a gallery's list of images; what is no number is none of them."""
    images = F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x, i: F.struct(i.alias("place"), _int(x, "").alias("image")))
    return F.filter(images, lambda x: x["image"] != 0)


def _stored_url() -> Column:
    """The address that an attachment was found with, null if it is none that can be stored."""
    return F.nullif(S.safe_url(F.col("resolved_url")), F.lit(""))


def _media(nodes: DataFrame, attachments: DataFrame, base_url: str) -> DataFrame:
    """id, node_id, gallery, image_id: what galleries and images find among the attachments."""
    from foliant.operators.inventory import ids_of_urls

    images = nodes.where(_is("image", "fullwidth_image")).select("id", "node_id", S.safe_url(F.element_at(F.map_from_entries("attrs"), "src")).alias("url")).where("url <> ''")
    known = ids_of_urls(images, attachments).where("attachment_id <> 0").select("id", "node_id", F.lit(None).cast(_GALLERY).alias("gallery"), F.col("attachment_id").alias("image_id"))
    return gallery_urls(nodes, attachments, base_url).withColumn("image_id", F.lit(None).cast("long")).unionByName(known)


def _html_note(b: Column) -> Column:
    """Module and message of a block of HTML that loses something, null of any other."""
    src = lambda element: _element_src(b["html"], element)
    unsafe = (b["kind"] == "embed") & (src("iframe") == "") & (src("video") != "") & (S.safe_url(src("video")) == "")
    said = F.when(unsafe, F.struct(F.lit("video").alias("module"), F.lit("A video whose source is no URL that can be stored was kept as HTML.").alias("message")))
    for kind, (module, text) in HTML_NOTES.items():
        said = said.when(b["kind"] == kind, F.struct(F.lit(module).alias("module"), F.lit(text).alias("message")))
    return said


def _fact(kind: str, module: Column, text: Column | None = None, value: Column | None = None, place: Column | None = None, ref: Column | None = None) -> Column:
    """What a node has to say: a message as it is (said), or what one is made from: an attribute (style), an image or a menu."""
    none = F.lit(None)
    parts = {"kind": (F.lit(kind), "string"), "module": (module, "string"), "text": (text, "string"), "value": (value, "string"), "node_id": (F.col("node_id"), "int"), "place": (place, "int"), "ref": (ref, "long")}
    return F.struct(*[(none if c is None else c).cast(t).alias(k) for k, (c, t) in parts.items()])


def warnings(nodes: DataFrame, attachments: DataFrame | None = None, menus: DataFrame | None = None, base_url: str = "", target: Target = Target()) -> DataFrame:
    """id, module, message, distinct: what each module loses as such, unknown tags, content in the wrong place, dropped media
    and design settings. `nodes` with LOOSE columns; `menus` (id, name).

    What counts of a node's texts is found where the node is read, so that no text is moved, and all that a node has to say is told
    in one row a fact: what is made of the facts reads one and the same shuffle."""
    noted = F.filter("blocks", lambda b: b["kind"].isin(*HTML_NOTES) | (b["kind"] == "embed"))
    notes = F.array_distinct(F.filter(F.transform(noted, _html_note), lambda x: x.isNotNull()))
    rows = visible(nodes.withColumns({"shows": _shows(), "nested": F.contains("content", F.lit("[" + PREFIX)), "html_notes": notes}))
    rows = rows.select("id", "node_id", "tag", "parent_tag", "last_id", "columns", "a", "shows", "nested", "html_notes")
    note = F.when(_is(*MAPS) & (F.col("columns") == 0) & ~_given(_a("address")) & ~(_given(_a("address_lat")) & _given(_a("address_lng"))), F.lit(None).cast("string"))
    for module, text in NOTES.items():
        note = note.when(_is(module), text)
    webm = S.safe_url(_a("src_webm"))
    alone = F.lit(None).cast("string")
    messages = F.array(
        note,
        F.when(~_known(), "This module is not known; its content was kept as it stood."),
        F.when(_is("image", "fullwidth_image") & (S.trimmed(_a("src")) != "") & (S.safe_url(_a("src")) == ""), "An image was dropped: its source is no URL that can be stored."),
        F.when(_is("section") & _given(_a("background_image")), "A section's background image was not carried over."),
        F.when(_is("section", "row", "row_inner", "column", "column_inner") & S.border_radius(_a("border_radii"))["mixed"], "A border radius that differs by corner was not carried over."),
        F.when((_is("video") | _is("video_slider_item") & _in("video_slider")) & (S.safe_url(_a("src")) != "") & (webm != "") & (webm != S.safe_url(_a("src"))), "A second video source was not carried over; check whether it was another video."),
        F.when(_is("gallery") & (F.coalesce(_a("gallery_ids"), F.lit("")) != "") & _slider_gallery(), "A gallery slider became a grid, with a class to tell it by."),
        F.when(_is("counter") & _has_children() & F.col("nested"), "Modules inside a counter's label were reduced to their words."),
        F.when(_is("toggle"), F.when(target.has("details"), alone).otherwise("A toggle became a heading and text, as the host has no details block.")),
    )
    tag, parent, is_text = F.col("tag"), F.col("parent_tag"), F.col("tag") == TEXT
    unexpected = F.lit(False)
    for module, child in EXPECTS.items():
        unexpected = unexpected | _in(module) & ~_is(child)
    nameless = _is("social_media_follow_network") & _in("social_media_follow") & ~_given(_a("social_network")) & (S.trimmed(_a("url")) != "")
    # parts that their parents draw by themselves aren't held against the catalogue
    drawn = _is("pricing_item") & _in("pricing_table") | _is("social_media_follow_network") & _in("social_media_follow") | _is(*PARTS) & _known()
    told = (
        F.when(~is_text, F.transform(F.filter(messages, lambda m: m.isNotNull()), lambda m: _fact("said", tag, m))),
        F.transform("html_notes", lambda x: _fact("said", x["module"], x["message"])),
        F.when(unexpected & (~is_text | F.col("shows")), F.array(_fact("said", parent, F.lit(UNEXPECTED)))),
        F.when(nameless, F.array(_fact("said", parent, F.lit("A link without a network was not carried over.")))),
        F.when(~is_text & ~drawn, F.transform(F.map_entries("a"), lambda x, i: _fact("style", tag, x["key"], x["value"], place=i))),
        F.when(_is("menu", "fullwidth_menu") & _given(_a("menu_id")), F.array(_fact("menu", tag, ref=_int(_a("menu_id"), "0")))),
        F.when(_is("gallery"), F.transform(_listed(_a("gallery_ids")), lambda x: _fact("image", tag, place=x["place"], ref=x["image"]))),
    )
    facts = rows.select("id", F.explode(F.concat(*[F.coalesce(x, F.array()) for x in told])).alias("f")).select("id", "f.*")
    of = lambda kind: facts.where(F.col("kind") == kind)
    mapped = nodes.sparkSession.createDataFrame([(PREFIX + m, n) for m, names in MAPPED.items() for n in names], "tag string, name string")
    named = of("style").select("id", "node_id", "place", F.col("module").alias("tag"), F.col("text").alias("name"), "value")
    styles = lost_styles(named, mapped).select("id", F.col("tag").alias("module"), F.concat(F.lit("Design settings were not carried over: "), "labels", F.lit(".")).alias("message"))
    out = of("said").select("id", "module", F.col("text").alias("message")).unionByName(styles).unionByName(_menu_warnings(of("menu").select("id", "module", F.col("ref").alias("menu_id")), menus))
    if attachments is not None:
        out = out.unionByName(_gallery_warnings(of("image").select(F.col("id").alias("doc"), "node_id", "module", F.col("ref").alias("id")), attachments, base_url))
    return out.distinct()


def _gallery_warnings(listed: DataFrame, attachments: DataFrame, base_url: str) -> DataFrame:
    """Of galleries' images (doc, node_id, module, id) that are gone."""
    from foliant.operators.inventory import resolve_attachments

    found = resolve_attachments(listed, attachments, base_url)
    counted = found.groupBy(F.col("doc").alias("id"), "node_id", "module").agg(F.count(F.lit(1)).alias("size"), F.count_if(_stored_url().isNull()).alias("gone")).where("gone > 0")
    text = F.when(F.col("gone") == F.col("size"), F.format_string("None of the %d images of a gallery are in the media library.", "gone")).otherwise(F.format_string("%d of the %d images of a gallery are not in the media library.", "gone", "size"))
    return counted.select("id", "module", text.alias("message"))


def _menu_warnings(wanted: DataFrame, menus: DataFrame | None) -> DataFrame:
    """Of menus (id, module, menu_id) that are to be made anew."""
    if menus is None:
        named = wanted.withColumn("menu_name", F.lit(None).cast("string"))
    else:
        from foliant.operators.inventory import menu_names

        named = menu_names(wanted.withColumnRenamed("id", "doc"), menus).withColumnRenamed("doc", "id")
    which = F.coalesce(F.concat(F.lit('"'), F.nullif("menu_name", F.lit("")), F.lit('"')), F.concat(F.lit("with the number "), F.col("menu_id").cast("string")))
    return named.select("id", "module", F.concat(F.lit("A menu became an empty navigation block; import the old menu "), which, F.lit(" there.")).alias("message"))


def acknowledged_losses(nodes: DataFrame, attachments: DataFrame | None = None, base_url: str = "") -> DataFrame:
    """id, acknowledged (struct of words, links, images, buttons): what rendering is known to drop, for the census to allow.

    A section's background image, gallery images that are gone, a second video source, a social link without a network, and
    all but the words of modules inside a counter's label. `nodes` with LOOSE columns."""
    from foliant.functions.census import KINDS, source_census

    # the only text that counts here, counted where the node is read, so that none is moved
    nodes = visible(nodes.withColumn("lost_label", F.when(_is("counter") & _has_children(), source_census(F.col("content")))))
    webm, src = S.safe_url(_a("src_webm")), S.safe_url(_a("src"))
    second = (_is("video") | _is("video_slider_item") & _in("video_slider")) & (src != "") & (webm != "") & (webm != src)
    nameless = _is("social_media_follow_network") & _in("social_media_follow") & (S.trimmed(_a("url")) != "") & ~_given(_a("social_network"))
    links = F.when(second | nameless, 1).otherwise(0)
    images = F.when(_is("section") & _given(_a("background_image")), 1).otherwise(0)
    rows = nodes.select("id", links.alias("links"), images.alias("images"), F.col("lost_label").alias("label"))
    rows = rows.select("id", F.lit(0).cast("long").alias("words"), (F.col("links") + F.coalesce("label.links", F.lit(0))).alias("links"), (F.col("images") + F.coalesce("label.images", F.lit(0))).alias("images"), F.coalesce("label.buttons", F.lit(0)).alias("buttons"))
    if attachments is not None:
        gone = gallery_urls(nodes, attachments, base_url).select("id", F.size(F.filter("gallery", lambda x: x["url"].isNull())).cast("long").alias("images"))
        none = F.lit(0).cast("long")
        rows = rows.unionByName(gone.select("id", none.alias("words"), none.alias("links"), "images", none.alias("buttons")))
    return rows.groupBy("id").agg(*[F.sum(k).alias(k) for k in KINDS]).select("id", F.struct(*KINDS).alias("acknowledged"))


def convert(docs: DataFrame, attachments: DataFrame | None = None, base_url: str = "", target: Target = Target(), nodes: DataFrame | None = None, targets: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """id, markup of every row of `docs` (id, post_content): documents without a complete opening tag are passed through, those
    without a body have none. `nodes` is the documents' node table with LOOSE columns, where it is there already; `targets` (id,
    target; see `targets_of`) what each document is written for, in place of one `target` for all; `also` are further columns of
    `docs`."""
    parts = pieces(node_table(docs, loose=True) if nodes is None else nodes, attachments, base_url, target, targets)
    said = F.when(F.col("piece") != "", F.struct("at", "side", "inner", "piece"))  # a list leaves nulls out
    joined = parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["piece"]), "").alias("markup"), F.max("module").alias("_opened"))
    tidy = F.btrim(F.regexp_replace(F.coalesce("markup", F.lit("")), r"\n{3,}", "\n\n"), F.lit(S.BLANKS))
    made = F.when(F.col("_opened") & F.col("post_content").isNotNull(), tidy).otherwise(F.col("post_content"))
    return docs.select("id", "post_content", *also).join(joined, "id", "left").select("id", made.alias("markup"), *also)
