"""Documents that use every module, made from the driver's texts, with the markup and warnings that each must come out as.

Sources and results are written out by hand, so that the SQL of the rendering queries restates nothing of the renderer.
{t} stands for a document's text, {i} for its id; in results {t} is the text as a paragraph holds it, {image} the block of
the gallery image with the document's id, '' where it is gone.
"""

from __future__ import annotations

from typing import NamedTuple


class Shape(NamedTuple):
    source: str
    markup: str
    #: module without its prefix (or another name after "="), message
    warned: tuple[tuple[str, str], ...] = ()


def _b(name: str, html: str, attrs: str = "") -> str:
    return f"<!-- wp:{name}{attrs and ' ' + attrs} -->\n{html}\n<!-- /wp:{name} -->\n\n"


def _v(name: str, attrs: str = "") -> str:
    return f"<!-- wp:{name}{attrs and ' ' + attrs} /-->\n\n"


def _p(html: str) -> str:
    return _b("paragraph", f"<p>{html}</p>")


def _g(inner: str) -> str:
    return _b("group", f'<div class="wp-block-group">\n{inner}\n</div>')


def _h(level: int, html: str) -> str:
    return _b("heading", f"<h{level}>{html}</h{level}>", f'{{"level":{level}}}')


def _row(*buttons: str, attrs: str = "", classes: str = "") -> str:
    return _b("buttons", f'<div class="wp-block-buttons{classes}">\n{"".join(buttons)}\n</div>', attrs)


def _button(url: str, text: str, attrs: str = "", classes: str = "", div: str = "", more: str = "", style: str = "") -> str:
    return _b("button", f'<div class="wp-block-button{div}"><a class="wp-block-button__link wp-element-button{classes}"{style} href="{url}"{more}>{text}</a></div>', attrs)


def _items(*texts: str) -> str:
    return "".join(_b("list-item", f"<li>{t}</li>") for t in texts)


def _list(*texts: str) -> str:
    return _b("list", f'<ul class="wp-block-list">\n{_items(*texts)}</ul>')


def _picture(src: str, alt: str, attrs: str = '{"sizeSlug":"large","linkDestination":"none"}', classes: str = "", style: str = "") -> str:
    return _b("image", f'<figure class="wp-block-image size-large{classes}"{style}><img src="{src}" alt="{alt}"/></figure>', attrs)


def _embed(provider: str, url: str) -> str:
    return _b("embed", f'<figure class="wp-block-embed is-type-video is-provider-{provider} wp-block-embed-{provider}"><div class="wp-block-embed__wrapper">\n{url}\n</div></figure>', f'{{"url":"{url}","type":"video","providerNameSlug":"{provider}"}}')


def _film(src: str) -> str:
    return _b("video", f'<figure class="wp-block-video"><video controls src="{src}"></video></figure>', f'{{"src":"{src}"}}')


def _cover(url: str, inner: str, color: str = "") -> str:
    attrs = f'{{"url":"{url}"' + (f',"customOverlayColor":"{color}"' if color else "") + "}"
    style = f' style="background-color:{color}"' if color else ""
    return _b("cover", f'<div class="wp-block-cover"><img class="wp-block-cover__image-background" alt="" src="{url}" data-object-fit="cover"/><span aria-hidden="true" class="wp-block-cover__background has-background-dim-100 has-background-dim"{style}></span><div class="wp-block-cover__inner-container">\n{inner}\n</div></div>', attrs)


def _details(title: str, inner: str, attrs: str = "", opened: str = "") -> str:
    return _b("details", f'<details class="wp-block-details"{opened}><summary>{title}</summary>' + (f"\n{inner}" if inner else "") + "</details>", attrs)


_CENTRED = '{"textAlign":"center","level":%d}'


def _ch(level: int, html: str) -> str:
    return _b("heading", f'<h{level} class="has-text-align-center">{html}</h{level}>', _CENTRED % level)


def _cp(html: str) -> str:
    return _b("paragraph", f'<p class="has-text-align-center">{html}</p>', '{"align":"center"}')


_FLEX = '{"layout":{"type":"flex","justifyContent":"center"}}'
_JUSTIFIED = " is-content-justification-center"
_SOCIAL = lambda *links: _b("social-links", '<ul class="wp-block-social-links">\n' + "".join(_v("social-link", f'{{"url":"{u}","service":"{s}"}}') for s, u in links) + "</ul>")
_QUERY = lambda inner, attrs: _b("query", '<div class="wp-block-query">\n' + _b("post-template", inner) + "</div>", attrs)
_THREE = _v("post-featured-image") + _v("post-title") + _v("post-excerpt")

_STRAY = "Content that this module does not hold of itself was kept in its place; check where it landed."
_SLIDER = "A slider became a stack of sections, one per slide, all visible at once."
_COUNTED = "A counter became a static heading; its animation was not carried over."
_PORTFOLIO = "A portfolio became a query over its post type, which must be registered by something else."
_LOST = "Design settings were not carried over: "

SHAPES: tuple[Shape, ...] = (
    Shape(
        '[et_pb_section fullwidth="on" background_color="#ABC" custom_margin="1px||2px|"][et_pb_row border_color_all="red" border_radii="on|3px|3px|3px|3px"][et_pb_column type="1_2" custom_padding="|4px||"]'
        '[et_pb_text custom_padding="10px||20px|" body_text_color="#111" body_font_size="12px" body_line_height="1.5" text_orientation="center"]About {t}[/et_pb_text][/et_pb_column][/et_pb_row][/et_pb_section]',
        _b("group", '<div class="wp-block-group has-background" style="background-color:#ABC;margin-top:1px;margin-bottom:2px">\n' + _b("columns", '<div class="wp-block-columns has-border-color" style="border-color:red;border-radius:3px">\n' + _b("column", '<div class="wp-block-column" style="padding-right:4px;flex-basis:50%">\n' + _b("group", '<div class="wp-block-group" style="padding-top:10px;padding-bottom:20px">\n' + _b(
            "paragraph", '<p class="has-text-align-center has-text-color" style="color:#111;font-size:12px;line-height:1.5">About {t}</p>', '{"align":"center","style":{"color":{"text":"#111"},"typography":{"fontSize":"12px","lineHeight":"1.5"}}}')
            + "\n</div>", '{"style":{"spacing":{"padding":{"top":"10px","bottom":"20px"}}}}') + "\n</div>", '{"width":"50%","style":{"spacing":{"padding":{"right":"4px"}}}}') + "\n</div>", '{"style":{"border":{"color":"red","radius":"3px"}}}') + "\n</div>", '{"style":{"color":{"background":"#ABC"},"spacing":{"margin":{"top":"1px","bottom":"2px"}}},"layout":{"type":"full"}}'),
    ),
    Shape(
        '[et_pb_section background_image="https://e.com/b.jpg" background_color="#fff" background_enable_color="off" border_radii="on|1px|2px|1px|1px"][et_pb_row][et_pb_column type="4_4"][et_pb_row_inner][et_pb_column_inner type="1_3"]About {t}[/et_pb_column_inner][/et_pb_row_inner][/et_pb_column][/et_pb_row][et_pb_row]Loose {t}[/et_pb_row][/et_pb_section]',
        _b("group", '<div class="wp-block-group">\n' + _b("columns", '<div class="wp-block-columns">\n' + _b("column", '<div class="wp-block-column" style="flex-basis:100%">\n' + _b("columns", '<div class="wp-block-columns">\n' + _b("column", '<div class="wp-block-column" style="flex-basis:33.33%">\n' + _p("About {t}") + "\n</div>", '{"width":"33.33%"}') + "\n</div>") + "\n</div>", '{"width":"100%"}') + "\n</div>") + _p("Loose {t}") + "\n</div>", '{"layout":{"type":"constrained"}}'),
        (("section", "A section's background image was not carried over."), ("section", "A border radius that differs by corner was not carried over.")),
    ),
    Shape(
        '[et_pb_text header_text_color="red" header_font_size="2em" hover_enabled="1" custom_css_main="x" module_id="top"]intro <b>b</b><h3 class="x">Head</h3><ul class="k"><li>one<ol><li>two</li></ol></li></ul><blockquote><p>said</p><cite>Ann</cite></blockquote><table><tr><td>c</td></tr></table><table border="1"><tr><td>d</td></tr></table><pre>x  y</pre><hr><!-- note --><!-- wp:x --><div><p style="a">About {t}</p></div>[/et_pb_text]',
        _p("intro <b>b</b>") + _b("heading", '<h3 class="has-text-color" style="color:red;font-size:2em">Head</h3>', '{"level":3,"style":{"color":{"text":"red"},"typography":{"fontSize":"2em"}}}') + _b("list", '<ul class="wp-block-list">\n' + _b("list-item", "<li>one\n" + _b("list", '<ol class="wp-block-list">\n' + _items("two") + "</ol>", '{"ordered":true}') + "</li>") + "</ul>")
        + _b("quote", '<blockquote class="wp-block-quote">\n' + _p("said") + "<cite>Ann</cite></blockquote>") + _b("table", '<figure class="wp-block-table"><table><tbody><tr><td>c</td></tr></tbody></table></figure>', '{"hasFixedLayout":false}') + _b("html", '<table border="1"><tr><td>d</td></tr></table>')
        + _b("preformatted", '<pre class="wp-block-preformatted">x  y</pre>') + _b("separator", '<hr class="wp-block-separator has-alpha-channel-opacity"/>') + _b("html", "<!-- note -->") + _p("About {t}"),
        (("=html-comment", "A block delimiter inside the content was removed."), ("text", _LOST + "changes on hover, own CSS, own ids and classes.")),
    ),
    Shape(
        '[et_pb_code]<script>1</script>[/et_pb_code][et_pb_fullwidth_code]About {t}[/et_pb_fullwidth_code][et_pb_button button_text="Salt &amp; Pepper" button_url="https://e.com/?a=1&b={i}" button_alignment="center" button_bg_color="#fff" button_text_color="Red" url_new_window="on" custom_margin="1px|||" /][et_pb_button /]',
        _b("html", "<script>1</script>") + _b("html", "About {t}") + _b("buttons", '<div class="wp-block-buttons is-content-justification-center" style="margin-top:1px">\n' + _button("https://e.com/?a=1&amp;b={i}", "Salt &amp; Pepper", '{"style":{"color":{"background":"#fff","text":"red"}}}', " has-background has-text-color", more=' target="_blank" rel="noopener noreferrer"', style=' style="background-color:#fff;color:red"') + "\n</div>", '{"layout":{"type":"flex","justifyContent":"center"},"style":{"spacing":{"margin":{"top":"1px"}}}}')
        + _row(_button("#", "Click Here")),
    ),
    Shape(
        '[et_pb_image src="https://e.com/{i}.png" alt="A &amp; B" align="center" url="https://e.com/x" custom_padding="1px|||"]<p>cap <em>e</em></p>[/et_pb_image][et_pb_fullwidth_image src="https://e.com/w.png" /][et_pb_image src="javascript:x" /][et_pb_image /]',
        _b("image", '<figure class="wp-block-image size-large aligncenter" style="padding-top:1px"><a href="https://e.com/x"><img src="https://e.com/{i}.png" alt="A &amp; B"/></a><figcaption class="wp-element-caption">cap <em>e</em></figcaption></figure>', '{"sizeSlug":"large","linkDestination":"custom","url":"https://e.com/{i}.png","alt":"A \\u0026amp; B","href":"https://e.com/x","align":"center","style":{"spacing":{"padding":{"top":"1px"}}}}')
        + _picture("https://e.com/w.png", "", '{"sizeSlug":"large","linkDestination":"none","url":"https://e.com/w.png","alt":""}'),
        (("image", "An image was dropped: its source is no URL that can be stored."),),
    ),
    Shape(
        '[et_pb_video src="https://www.youtube.com/embed/abc{i}" /][et_pb_video]https://vimeo.com/{i}[/et_pb_video][et_pb_video]<iframe src="https://player.vimeo.com/video/1{i}"></iframe>[/et_pb_video][et_pb_video src="https://e.com/a.mp4" src_webm="https://e.com/b.webm" custom_margin="2px|||" /][et_pb_video /]',
        _embed("youtube", "https://www.youtube.com/watch?v=abc{i}") + _embed("vimeo", "https://vimeo.com/{i}") + _embed("vimeo", "https://vimeo.com/1{i}")
        + _b("video", '<figure style="margin-top:2px" class="wp-block-video"><video controls src="https://e.com/a.mp4"></video></figure>', '{"src":"https://e.com/a.mp4","style":{"spacing":{"margin":{"top":"2px"}}}}'),
        (("video", "A second video source was not carried over; check whether it was another video."),),
    ),
    Shape(
        '[et_pb_video_slider custom_margin="3px|||"][et_pb_video_slider_item src="https://e.com/a.mp4" /][et_pb_video_slider_item]About {t}[/et_pb_video_slider_item][/et_pb_video_slider][et_pb_video_slider_item]alone[/et_pb_video_slider_item][et_pb_text]a <iframe src="https://notvimeo.com/1"></iframe> b <video src="https://e.com/v.mp4"></video>[/et_pb_text]',
        _b("group", '<div class="wp-block-group" style="margin-top:3px">\n' + _film("https://e.com/a.mp4") + _p("About {t}") + "\n</div>", '{"style":{"spacing":{"margin":{"top":"3px"}}}}') + _p("alone") + _p("a") + _b("html", '<iframe src="https://notvimeo.com/1"></iframe>') + _p("b") + _film("https://e.com/v.mp4"),
        (("video_slider", "A video slider became a stack of videos."), ("video_slider_item", "This module is not known; its content was kept as it stood.")),
    ),
    Shape(
        '[et_pb_audio audio="https://e.com/a.mp3" custom_padding="1px|||" /][et_pb_audio audio="https://e.com/b.mp3" title="T" artist_name="Ann" image_url="https://e.com/i.png" custom_padding="1px|||" /][et_pb_audio title="none" /]',
        _b("audio", '<figure style="padding-top:1px" class="wp-block-audio"><audio controls src="https://e.com/a.mp3"></audio></figure>', '{"src":"https://e.com/a.mp3","style":{"spacing":{"padding":{"top":"1px"}}}}')
        + _b("group", '<div class="wp-block-group" style="padding-top:1px">\n' + _picture("https://e.com/i.png", "T") + _h(4, "T") + _p("Ann") + _b("audio", '<figure class="wp-block-audio"><audio controls src="https://e.com/b.mp3"></audio></figure>', '{"src":"https://e.com/b.mp3"}') + "\n</div>", '{"style":{"spacing":{"padding":{"top":"1px"}}}}'),
    ),
    Shape(
        '[et_pb_gallery gallery_ids="{i}, 999,0" gallery_columns="12" gallery_link="off" custom_margin="1px|||" /][et_pb_gallery /][et_pb_gallery gallery_ids="998" fullwidth="on" columns_number="2" /]',
        _b("gallery", '<figure class="wp-block-gallery has-nested-images columns-8 is-cropped" style="margin-top:1px">\n{image}</figure>', '{"columns":8,"linkTo":"none","imageCrop":true,"style":{"spacing":{"margin":{"top":"1px"}}}}') + _p("[Gallery — no images specified]")
        + _b("gallery", '<figure class="wp-block-gallery has-nested-images columns-2 is-cropped d2g-gallery-slider">\n</figure>', '{"columns":2,"linkTo":"media","imageCrop":true,"className":"d2g-gallery-slider"}'),
        (("gallery", "A gallery slider became a grid, with a class to tell it by."), ("gallery", "None of the 1 images of a gallery are in the media library."), ("gallery", "{gone}")),
    ),
    Shape(
        '[et_pb_map address="Main St &amp; 5th"]stray[et_pb_map_pin title="Home"]About {t}[/et_pb_map_pin][et_pb_map_pin]untitled[/et_pb_map_pin][/et_pb_map][et_pb_fullwidth_map address_lat="1.5" address_lng="2.5" /][et_pb_map /][et_pb_map_pin title="x"]lone[/et_pb_map_pin]',
        _g(_b("html", "<p><strong>Map:</strong> Main St &amp; 5th</p><p><strong>Home</strong>: About {t}</p>")) + _g(_b("html", "<p><strong>Map:</strong> 1.5, 2.5</p>")) + _p("lone"),
        (("map", "A map became text: its address and pins."), ("fullwidth_map", "A map became text: its address and pins."), ("map_pin", "This module is not known; its content was kept as it stood.")),
    ),
    Shape(
        '[et_pb_blurb title="Hi" url="https://e.com/u" image="https://e.com/i.png" header_level="h2" url_new_window="on" body_text_color="blue"]About {t}[/et_pb_blurb][et_pb_blurb title="0" header_level="h9" /][et_pb_cta title="Go" button_text="Now" button_url="https://e.com/go" background_color="#123"]About {t}[/et_pb_cta]',
        _g(_b("image", '<figure class="wp-block-image size-large"><a href="https://e.com/u" target="_blank" rel="noopener noreferrer"><img src="https://e.com/i.png" alt="Hi"/></a></figure>', '{"sizeSlug":"large","linkDestination":"custom"}') + _h(2, '<a href="https://e.com/u" target="_blank" rel="noopener noreferrer">Hi</a>') + _b("paragraph", '<p class="has-text-color" style="color:blue">About {t}</p>', '{"style":{"color":{"text":"blue"}}}')) + _g("")
        + _b("group", '<div class="wp-block-group has-background" style="background-color:#123">\n' + _h(2, "Go") + _p("About {t}") + _row(_button("https://e.com/go", "Now")) + "\n</div>", '{"style":{"color":{"background":"#123"}}}'),
    ),
    Shape(
        '[et_pb_divider /][et_pb_divider color="#0a0" custom_margin="||5px|" /][et_pb_fullwidth_header title="T" subhead="S" background_image="https://e.com/b.jpg" background_color="#222" button_one_text="One" button_one_url="https://e.com/1" button_two_text="Two"]About {t}[/et_pb_fullwidth_header][et_pb_fullwidth_header title="Plain" /]',
        _b("separator", '<hr class="wp-block-separator has-alpha-channel-opacity"/>') + _b("separator", '<hr class="wp-block-separator has-text-color has-alpha-channel-opacity has-background" style="margin-bottom:5px;background-color:#0a0;color:#0a0"/>', '{"style":{"color":{"background":"#0a0"},"spacing":{"margin":{"bottom":"5px"}}}}')
        + _cover("https://e.com/b.jpg", _b("heading", '<h1 class="has-text-align-center">T</h1>', '{"level":1,"textAlign":"center"}') + _b("paragraph", '<p class="has-text-align-center has-large-font-size">S</p>', '{"align":"center","fontSize":"large"}') + _cp("About {t}")
        + _row(_button("https://e.com/1", "One"), _button("#", "Two", '{"className":"is-style-outline"}', div=" is-style-outline"), attrs=_FLEX, classes=_JUSTIFIED), "#222") + _g(_b("heading", '<h1 class="has-text-align-center">Plain</h1>', '{"level":1,"textAlign":"center"}')),
    ),
    Shape(
        '[et_pb_testimonial author="Ann" company_name="Co" url="https://co.example/" portrait_url="https://e.com/p.png"]About {t}[/et_pb_testimonial][et_pb_testimonial author="Bo" /][et_pb_testimonial /]',
        _g(_picture("https://e.com/p.png", "Ann", '{"sizeSlug":"large","linkDestination":"none","className":"is-style-rounded"}', " is-style-rounded") + _b("quote", '<blockquote class="wp-block-quote">\n' + _p("About {t}") + '<cite><strong>Ann</strong>, <a href="https://co.example/">Co</a></cite></blockquote>'))
        + _g(_b("quote", '<blockquote class="wp-block-quote">\n' + _p("") + "<cite><strong>Bo</strong></cite></blockquote>")) + _g(""),
    ),
    Shape(
        '[et_pb_team_member name="Ann" position="Chief" image_url="https://e.com/a.png" twitter_url="https://t.example/a" facebook_url="https://f.example/a"]About {t}[/et_pb_team_member][et_pb_social_media_follow][et_pb_social_media_follow_network social_network="x" url="https://x.example/1" /][et_pb_social_media_follow_network social_network="y" /]'
        '[et_pb_social_media_follow_network social_network="x" url="https://x.example/2" /]between[et_pb_social_media_follow_network url="https://lost.example/" /][/et_pb_social_media_follow][et_pb_social_media_follow_network social_network="z" url="https://z.example/" /]',
        _g(_picture("https://e.com/a.png", "Ann") + _h(3, "Ann") + _b("paragraph", '<p class="has-small-font-size"><em>Chief</em></p>', '{"fontSize":"small"}') + _p("About {t}") + _SOCIAL(("facebook", "https://f.example/a"), ("twitter", "https://t.example/a"))) + _SOCIAL(("x", "https://x.example/2"), ("y", "#")) + _p("between") + _v("social-link", '{"url":"https://z.example/","service":"z"}'),
        (("social_media_follow", _STRAY), ("social_media_follow", "A link without a network was not carried over.")),
    ),
    Shape(
        '[et_pb_accordion][et_pb_toggle title="Q &amp; A" open="on" body_font_size="9px"]About {t}[/et_pb_toggle][et_pb_toggle][/et_pb_toggle][/et_pb_accordion]',
        _g(_details("Q &amp; A", _b("paragraph", '<p style="font-size:9px">About {t}</p>', '{"style":{"typography":{"fontSize":"9px"}}}'), '{"showContent":true}', " open") + _details("Toggle", "")),
        (("accordion", "An accordion became independent details blocks; opening one no longer closes the others."),),
    ),
    Shape(
        '[et_pb_tabs]Before[et_pb_tab title="One"]About {t}[/et_pb_tab][et_pb_tab]two[/et_pb_tab][et_pb_button button_text="Keep" /][/et_pb_tabs]',
        _g(_p("Before") + _g(_h(3, "One") + _p("About {t}")) + _g(_h(3, "Tab") + _p("two")) + _row(_button("#", "Keep"))),
        (("tabs", "Tabs became headed sections, one below the other, all visible at once."), ("tabs", _STRAY)),
    ),
    Shape(
        '[et_pb_slider][et_pb_slide heading="One" button_text="More" button_link="https://e.com/m" background_image="https://e.com/s.jpg"]About {t}[/et_pb_slide][/et_pb_slider][et_pb_fullwidth_slider][et_pb_slide heading="Two" image="https://e.com/2.jpg" /][/et_pb_fullwidth_slider][et_pb_post_slider /][et_pb_fullwidth_post_slider][et_pb_slide]three[/et_pb_slide][/et_pb_fullwidth_post_slider]',
        _g(_cover("https://e.com/s.jpg", _h(2, "One") + _p("About {t}") + _row(_button("https://e.com/m", "More")))) + _g(_cover("https://e.com/2.jpg", _h(2, "Two"))) + _g("") + _g(_g(_p("three"))),
        (("slider", _SLIDER), ("fullwidth_slider", _SLIDER), ("post_slider", _SLIDER), ("fullwidth_post_slider", _SLIDER)),
    ),
    Shape(
        '[et_pb_counters][et_pb_counter percent="50"]<p>Half\nway</p>[/et_pb_counter][et_pb_counter title="Own" /][et_pb_counter percent="7"]L[et_pb_button button_text="b" /][/et_pb_counter][/et_pb_counters][et_pb_number_counter number="12" title="N" /][et_pb_circle_counter number="3" percent_sign="off" /]About {t}',
        _g(_p("<strong>Half way</strong>: 50%") + _p("<strong>Own</strong>: 0%") + _p("<strong>L</strong>: 7%")) + _g(_ch(2, "12%") + _cp("N")) + _g(_ch(2, "3")) + _p("About {t}"),
        (("counter", "A bar counter became a line of text; its bar and animation were not carried over."), ("counter", "Modules inside a counter's label were reduced to their words."), ("number_counter", _COUNTED), ("circle_counter", _COUNTED)),
    ),
    Shape(
        '[et_pb_pricing_tables][et_pb_pricing_table title="Pro" subtitle="best" sum="9" per="mo" button_text="Buy" button_url="https://e.com/buy"][et_pb_pricing_item]a[/et_pb_pricing_item] [et_pb_pricing_item available="off"]<b>b</b>[/et_pb_pricing_item]About {t}[et_pb_pricing_item]c[/et_pb_pricing_item][/et_pb_pricing_table][et_pb_pricing_table currency="€" sum="1"]plain[/et_pb_pricing_table][/et_pb_pricing_tables][et_pb_pricing_item]lone[/et_pb_pricing_item]',
        _b("columns", '<div class="wp-block-columns">\n' + _b("column", '<div class="wp-block-column">\n' + _ch(3, "Pro") + _cp("best") + _ch(2, "$9<small>/mo</small>") + _list("a", "<s>b</s>") + _p("About {t}") + _list("c") + _row(_button("https://e.com/buy", "Buy"), attrs=_FLEX, classes=_JUSTIFIED) + "\n</div>") + _b("column", '<div class="wp-block-column">\n' + _ch(2, "€1") + _p("plain") + "\n</div>") + "\n</div>") + _list("lone"),
        (("pricing_table", _STRAY),),
    ),
    Shape(
        '[et_pb_blog posts_number="7 posts" include_categories="3, 5x" /][et_pb_blog /][et_pb_portfolio posts_number="2" include_categories="4,6" /][et_pb_filterable_portfolio fullwidth="on" /][et_pb_fullwidth_portfolio /]About {t}',
        _v("latest-posts", '{"postsToShow":7,"categories":[{"id":3},{"id":5}]}') + _v("latest-posts", '{"postsToShow":10}') + _QUERY(_THREE, '{"query":{"postType":"project","perPage":2,"order":"desc","orderBy":"date","taxQuery":{"project_category":[4,6]}}}')
        + _QUERY(_v("post-featured-image") + _v("post-title"), '{"query":{"postType":"project","perPage":4,"order":"desc","orderBy":"date"}}') + _QUERY(_THREE, '{"query":{"postType":"project","perPage":4,"order":"desc","orderBy":"date"}}') + _p("About {t}"),
        (("portfolio", _PORTFOLIO), ("filterable_portfolio", _PORTFOLIO), ("fullwidth_portfolio", _PORTFOLIO)),
    ),
    Shape(
        '[et_pb_menu menu_id="99" /][et_pb_fullwidth_menu menu_id="7" /][et_pb_menu /][et_pb_search placeholder="Find" /][et_pb_search /][et_pb_post_title /][et_pb_comments /][et_pb_login /][et_pb_sidebar area="left" /][et_pb_sidebar /][et_pb_shop type="sale" /]About {t}',
        _v("navigation") * 3 + _v("search", '{"placeholder":"Find"}') + _v("search") + _v("post-title") + _b("comments", '<div class="wp-block-comments"></div>') + _v("loginout") + _p("<em>[Sidebar: left]</em>") + _p("<em>[Sidebar: sidebar-1]</em>") + _p("<em>[Shop: sale, 4 columns, 4 products]</em>") + _p("About {t}"),
        (("menu", 'A menu became an empty navigation block; import the old menu "Main" there.'), ("fullwidth_menu", "A menu became an empty navigation block; import the old menu with the number 7 there."), ("sidebar", "A sidebar became a placeholder; add its widgets as blocks."), ("shop", "A shop module became a placeholder; add the shop's own blocks.")),
    ),
    Shape(
        '[et_pb_contact_form title="Write" email="a@example.com" submit_button_text="Go"]stray[et_pb_contact_field field_title="Name" field_type="input" /][et_pb_contact_field field_id="pick" field_type="select" required_mark="off" field_options="a|b" /][et_pb_contact_field field_type="odd" /][/et_pb_contact_form][et_pb_contact_form /][et_pb_contact_field]lone[/et_pb_contact_field]',
        _g(_h(3, "Write") + _p("<em>This was a contact form that was sent to a@example.com. Rebuild it from these fields.</em>") + _list("Name — text (required)", "pick — list to choose from<br/>a, b", "Field — odd (required)") + _p("<em>Its button said: Go</em>")) + _g(_p("<em>This was a contact form. Rebuild it from these fields.</em>") + _p("<em>Its button said: Send</em>")) + _p("lone"),
        (("contact_form", "A contact form became a list of its fields; rebuild it with a form plugin."), ("contact_field", "This module is not known; its content was kept as it stood.")),
    ),
    Shape(
        '[et_pb_signup description="News"]dropped[/et_pb_signup][et_pb_weird a="1"]About {t}[/et_pb_weird][et_pb_weird][et_pb_button button_text="In" /][/et_pb_weird][/et_pb_text]',
        _g(_h(3, "Subscribe") + _p("News") + _p("<em>[Sign-up form: add the provider's block here.]</em>")) + _p("About {t}") + _row(_button("#", "In")) + _p("[/et_pb_text]"),
        (("signup", "A sign-up form became text; rebuild it with the provider's block."), ("weird", "This module is not known; its content was kept as it stood.")),
    ),
    Shape("No tag here: {t}", "No tag here: {raw}"),
    Shape(
        "[et_pb_text title=&quot;a[0]&quot; background_color=&#34;red&quot; z_index='3']First[/et_pb_text][et_pb_text animation_style=&#8221;fade&#8221;]About {t}",
        _p("First") + _p("About {t}"),
        (("text", _LOST + "placement and transforms, animations and filters."),),
    ),
    Shape(  # implied ends, closers without an opener, lists in lists, elements that hold no tags, depth
        '[et_pb_text]<p>About {t}<div>b</section></div>c</p><ul><li>one<li>two<ul><li>three</ul><li>four</ul><ul><ul><li>alone</ul></ul><script>if (a<b) "</p>"</script><table><tr><td>p<td>q<tr><td>r</table>' + "<div>" * 12 + "<i>deep</i>" + "</div>" * 12 + "<b>x<i>y</b>z[/et_pb_text]",
        _p("About {t}") + _p("b") + _p("c") + _b("list", '<ul class="wp-block-list">\n' + _items("one") + _b("list-item", "<li>two\n" + _list("three") + "</li>") + _items("four") + "</ul>") + _b("list", '<ul class="wp-block-list">\n' + _b("list-item", "<li>\n" + _list("alone") + "</li>") + "</ul>")
        + _b("html", '<script>if (a<b) "</p>"</script>') + _b("table", '<figure class="wp-block-table"><table><tbody><tr><td>p<td>q<tr><td>r</tbody></table></figure>', '{"hasFixedLayout":false}') + _b("html", "<div><i>deep</i></div>") + _p("<b>x<i>y</b>z"),
    ),
    Shape(  # every kind of design setting
        '[et_pb_code custom_margin="1px|||" max_width="5px" border_color_all="red" box_shadow_style="preset1" text_shadow_style="preset2" body_font_size="3px" background_blend="x" parallax="on" animation_style="fade" custom_css_main="x" module_id="a" z_index="3" disabled_on="on|off|off" body_text_color="red" a_tablet="1" b__hover="1" unknown="1" min_height=""]About {t}[/et_pb_code]',
        _b("html", "About {t}"),
        (("code", _LOST + "inner and outer spacing, fixed sizes, border lines, shadows of boxes, shadows of text, font settings, background details, moving backgrounds, animations and filters, own CSS, own ids and classes, placement and transforms, visibility by device, colour of text, settings for smaller screens, changes on hover."),),
    ),
    Shape(  # media between and in text, an element that a closer of a lower rank doesn't leave, one that takes the rest
        '[et_pb_text]About {t}<iframe src="https://e.com/f">in</iframe><div>one <object data="o"><b>two</b></object> three</div><video src="https://e.com/v.mp4"></video>four<embed src="x"/><section>five</section><b>six<div>seven</b>eight</div>nine[/et_pb_text]',
        _p("About {t}") + _b("html", '<iframe src="https://e.com/f">in</iframe>') + _p("one") + _b("html", '<object data="o"><b>two</b></object>') + _p("three") + _film("https://e.com/v.mp4") + _p("four") + _b("html", '<embed src="x"/>') + _p("five") + _p("<b>six<div>seven</b>eight</div>nine"),
    ),
)


def _literal(text: str, **parts: str) -> str:
    """A string expression of SQL: text with the named parts put in."""
    sql = "'" + text.replace("'", "''") + "'"
    for name, part in parts.items():
        sql = sql.replace("{" + name + "}", f"' || {part} || '")
    return sql


_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
_UNIX = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_BODY = f"rtrim({_UNIX}, {_BLANKS})"
_ID = "CAST(doc_id AS STRING)"
#: A document's body, and as a query for both engines.
SOURCE = f"CASE doc_id % {len(SHAPES)} " + " ".join(f"WHEN {k} THEN {_literal(s.source, t='text', i=_ID)}" for k, s in enumerate(SHAPES)) + " END"
SOURCE_SQL = f"SELECT doc_id AS id, {SOURCE} AS post_content FROM documents"
#: Stands for a blank text in documents that are to be rendered, and is taken out of what they become: their SQL keeps the blank before
#: the text, which the renderer trims.
MARK = "\ue000"
_ESCAPED = "replace(found, '&', '&amp;')"
_JSON = "replace(replace(found, '--', '\\u002d\\u002d'), '&', '\\u0026')"
_IMAGE = "CASE WHEN found IS NULL THEN '' ELSE " + _literal('<!-- wp:image {"id":{i},"sizeSlug":"large","linkDestination":"{link}","url":"{json}","alt":""} -->\n<figure class="wp-block-image size-large"><img src="{url}" alt="" class="wp-image-{i}"/></figure>\n<!-- /wp:image -->\n\n', i=_ID, json=_JSON, url=_ESCAPED) + " END"
_FOUND = "coalesce(att.url, 'https://cdn.example.com/' || att.file, att.guid)"


def markup_sql(attachments: str) -> str:
    """SQL of DuckDB: id, markup of every document of SOURCE_SQL. `attachments` is a query of id, url, file and guid."""
    cases = []
    for k, s in enumerate(SHAPES):
        made = _literal(s.markup, t=_BODY, i=_ID, image=_IMAGE.replace("{link}", "none"), raw="text")
        tidy = f"trim(regexp_replace({made}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANKS})"
        cases.append(f"WHEN {k} THEN {made if '{raw}' in s.markup else tidy}")
    return f"WITH att AS ({attachments}), d AS (SELECT documents.*, {_FOUND} AS found FROM documents LEFT JOIN att ON att.id = doc_id)\nSELECT doc_id AS id, CASE WHEN text IS NULL THEN NULL ELSE CASE doc_id % {len(SHAPES)} {' '.join(cases)} END END AS markup FROM d"


def warnings_sql(attachments: str) -> str:
    """The same for id, module, message."""
    rows = ", ".join(f"({k}, '{m[1:] if m.startswith('=') else 'et_pb_' + m}', '{t.replace(chr(39), chr(39) * 2)}')" for k, s in enumerate(SHAPES) for m, t in s.warned)
    # of a gallery's two images the one with the document's id may be there
    gone = "CASE WHEN found IS NULL THEN 'None of the 2 images of a gallery are in the media library.' ELSE '1 of the 2 images of a gallery are not in the media library.' END"
    return f"WITH att AS ({attachments}), d AS (SELECT documents.*, {_FOUND} AS found FROM documents LEFT JOIN att ON att.id = doc_id), w(shape, module, message) AS (VALUES {rows})\nSELECT doc_id AS id, module, CASE WHEN message = '{{gone}}' THEN {gone} ELSE message END AS message FROM d JOIN w ON shape = doc_id % {len(SHAPES)} WHERE text IS NOT NULL AND (message <> '{{gone}}' OR doc_id <> 0)"


#: The tree of each shape: depth and tag of its nodes, _ for text.
TREES = (
    "0section 1row 2column 3text 4_", "0section 1row 2column 3row_inner 4column_inner 5_ 1row 2_", "0text 1_", "0code 1_ 0fullwidth_code 1_ 0button 0button", "0image 1_ 0fullwidth_image 0image 0image", "0video 0video 1_ 0video 1_ 0video 0video",
    "0video_slider 1video_slider_item 1video_slider_item 2_ 0video_slider_item 1_ 0text 1_", "0audio 0audio 0audio", "0gallery 0gallery 0gallery", "0map 1_ 1map_pin 2_ 1map_pin 2_ 0fullwidth_map 0map 0map_pin 1_", "0blurb 1_ 0blurb 0cta 1_", "0divider 0divider 0fullwidth_header 1_ 0fullwidth_header",
    "0testimonial 1_ 0testimonial 0testimonial", "0team_member 1_ 0social_media_follow 1social_media_follow_network 1social_media_follow_network 1social_media_follow_network 1_ 1social_media_follow_network 0social_media_follow_network", "0accordion 1toggle 2_ 1toggle", "0tabs 1_ 1tab 2_ 1tab 2_ 1button",
    "0slider 1slide 2_ 0fullwidth_slider 1slide 0post_slider 0fullwidth_post_slider 1slide 2_", "0counters 1counter 2_ 1counter 1counter 2_ 2button 0number_counter 0circle_counter 0_", "0pricing_tables 1pricing_table 2pricing_item 3_ 2pricing_item 3_ 2_ 2pricing_item 3_ 1pricing_table 2_ 0pricing_item 1_",
    "0blog 0blog 0portfolio 0filterable_portfolio 0fullwidth_portfolio 0_", "0menu 0fullwidth_menu 0menu 0search 0search 0post_title 0comments 0login 0sidebar 0sidebar 0shop 0_", "0contact_form 1_ 1contact_field 1contact_field 1contact_field 0contact_form 0contact_field 1_", "0signup 1_ 0weird 1_ 0weird 1button 0_", "", "0text 1_ 0text 1_", "0text 1_", "0code 1_", "0text 1_",
)
TREES_SQL = f"SELECT doc_id AS id, CASE doc_id % {len(SHAPES)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TREES)) + f" END AS tree FROM documents WHERE text IS NOT NULL AND doc_id % {len(SHAPES)} <> {TREES.index('')}"

#: The posts of the corpus: what each shape that holds a tag becomes. {para} is the text as a paragraph, '' without any.
_PARA = f"CASE WHEN trim({_UNIX}, {_BLANKS}) = '' THEN '' ELSE " + _literal(_p("{body}"), body=f"trim({_UNIX}, {_BLANKS})") + " END"
_PADDED = f"CASE WHEN trim({_UNIX}, {_BLANKS}) = '' THEN '' ELSE " + _literal(_b("group", '<div class="wp-block-group" style="padding-top:10px;padding-bottom:20px">\n' + _p("{body}") + "\n</div>", '{"style":{"spacing":{"padding":{"top":"10px","bottom":"20px"}}}}'), body=f"trim({_UNIX}, {_BLANKS})") + " END"
_POSTS = {
    0: _b("group", '<div class="wp-block-group">\n{padded}' + _row(_button("https://example.com/{source}/{lang}/", "Go")) + "\n</div>", '{"layout":{"type":"constrained"}}'),
    1: "{para}" + _b("gallery", '<figure class="wp-block-gallery has-nested-images columns-3 is-cropped">\n{image}</figure>', '{"columns":3,"linkTo":"media","imageCrop":true}'),
    3: "{para}",
}


def posts_views(attachments: str) -> str:
    """Views of DuckDB after that of the posts: att, and cv (id, post_content, found, tagged, markup) of all posts."""
    cases = " ".join(f"WHEN id % 5 = {k} THEN trim(regexp_replace({_literal(m, padded=_PADDED, para=_PARA, source='source', lang='lang', i=_ID, image=_IMAGE.replace('{link}', 'media'))}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANKS})" for k, m in _POSTS.items())
    return f""", att AS ({attachments}), pd AS (SELECT posts.id, posts.post_content, documents.*, {_FOUND} AS found FROM posts JOIN documents ON doc_id = posts.id LEFT JOIN att ON att.id = posts.id),
cv AS (SELECT id, post_content, found, coalesce(post_content IS NOT NULL AND id % 5 IN (0, 1, 3), false) AS tagged, CASE WHEN post_content IS NULL THEN NULL {cases} ELSE post_content END AS markup FROM pd) """


#: A document for hosts that differ, its site by language, and what it becomes for each.
HOSTED = '[et_pb_toggle title="T"]About {t}[/et_pb_toggle][et_pb_slide background_image="https://e.com/i.png"]x[/et_pb_slide][et_pb_portfolio include_categories="1" /]'
_HOSTED_QUERY = lambda kind, taxonomy: _QUERY(_THREE, f'{{"query":{{"postType":"{kind}","perPage":4,"order":"desc","orderBy":"date","taxQuery":{{"{taxonomy}":[1]}}}}}}')
_DIM, _IMG = '<span aria-hidden="true" class="wp-block-cover__background has-background-dim-100 has-background-dim"></span>', '<img class="wp-block-cover__image-background" alt="" src="https://e.com/i.png" data-object-fit="cover"/>'
_HOSTED_COVER = _cover("https://e.com/i.png", _p("x"))
#: site -> (major, minor, blocks that it lacks, type and taxonomy of portfolios), markup
HOSTS = {
    "en": ((6, 8, [], "project", "project_category"), _details("T", _p("About {t}")) + _HOSTED_COVER + _HOSTED_QUERY("project", "project_category")),
    "de": ((6, 3, [], "work", "kind"), _details("T", _p("About {t}"), '{"summary":"T"}') + _HOSTED_COVER.replace(_IMG + _DIM, _DIM + _IMG) + _HOSTED_QUERY("work", "kind")),
    "fr": ((6, 4, ["core/details"], None, None), _g(_h(3, "T") + _p("About {t}")) + _HOSTED_COVER.replace(_IMG + _DIM, _DIM + _IMG) + _HOSTED_QUERY("project", "project_category")),
}
HOSTED_SOURCE = _literal(HOSTED, t="text")


def hosted_markup_sql() -> str:
    """SQL of DuckDB: id, markup of every document of HOSTED_SOURCE."""
    tidy = lambda m: f"trim(regexp_replace({_literal(m, t=_BODY)}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANKS})"
    cases = " ".join(f"WHEN '{site}' THEN {tidy(m)}" for site, (_, m) in HOSTS.items())
    return f"SELECT doc_id AS id, CASE WHEN text IS NULL THEN NULL ELSE CASE lang {cases} ELSE {tidy(HOSTS['en'][1])} END END AS markup FROM documents"
