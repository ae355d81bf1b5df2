"""Labelled pages for html_extraction: what usual layouts put into which elements.

Written for this purpose. `x-main` holds the main text. Each layout is filled with the usual names
of its parts, so that every name is seen beside those it occurs with.
"""

from __future__ import annotations

_WORDS = "the river rose after days of rain and people moved their boats to higher ground before the evening".split()


def _text(n: int, k: int = 0) -> str:
    return " ".join(_WORDS[(i * 7 + k) % len(_WORDS)] for i in range(n))


def _main(k: int) -> str:
    head = f"<h1>{_text(6, k)}</h1><h2>{_text(5, k)}</h2>"
    paragraphs = "".join(f"<p>{_text(n, k)} <a href='/x'>{_text(2, k)}</a> <b>{_text(2)}</b> <em>{_text(1)}</em> <span>{_text(3)}</span></p>" for n in (40, 25, 60, 3))
    rest = f"<h3>{_text(4, k)}</h3><ul><li>{_text(12, k)}</li><li>{_text(9)}</li></ul><ol><li>{_text(14)}</li></ol><blockquote><p>{_text(20, k)}</p></blockquote><pre><code>{_text(15)}</code></pre><table><tr><td>{_text(6)}</td><td>{_text(6)}</td></tr></table><figure><figcaption>{_text(8)}</figcaption></figure><p><a href='/y'>{_text(5)}</a></p><ul><li><a href='/z'>{_text(4)}</a></li></ul><section><h2>{_text(3)}</h2><p>{_text(40)}</p><p>{_text(30)}</p><p>{_text(9)}</p></section><dl><dt>{_text(3)}</dt><dd>{_text(12)}</dd></dl>"
    return f"<x-main>{head}{paragraphs}{rest}</x-main>"


_LINKS = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in _WORDS[:8])
_MENU = f"<ul>{_LINKS}</ul>"
#: Usual class and id names of elements that hold the main text.
MAIN_NAMES = ("article", "article body", "post", "post content", "entry", "entry content", "content", "main", "main content", "story", "story body", "text", "body text", "page content")
#: Usual class, id and role names of everything else.
OTHER_NAMES = (
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "pagination", "pager", "tabs", "toc",
    "header", "masthead", "banner", "footer", "copyright", "legal", "contentinfo", "sidebar", "aside", "rail", "complementary", "widget", "widgets",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "promoted", "adsense", "dfp",
    "notice", "notices", "notification", "alert", "warning", "cookie", "cookies", "consent", "gdpr", "privacy", "popup", "modal", "overlay", "dialog",
    "form", "search", "login", "signin", "signup", "subscribe", "subscription", "newsletter", "contact",
    "comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "reader",
    "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "popular", "tags", "meta", "byline", "skip", "print", "hidden",
)


def _page(open_main: str, close_main: str, k: int, names: tuple[str, ...]) -> str:
    around = "".join(f"<div class='{n}'><p>{_text(10, i)}</p><div><a href='/'>{_text(3)}</a> <span>{_text(2)}</span></div>{_MENU if i % 3 == 0 else ''}</div>" for i, n in enumerate(names))
    inner = "".join(f"<div class='{n}'><h3>{_text(2)}</h3><p>{_text(9, i)}</p></div><section id='{n}'><p>{_text(12, i)}</p></section>" if i % 2 else f"<div id='{n}'><p>{_text(12, i)}</p></div>" for i, n in enumerate(names))
    return f"""<html><head><title>{_text(6)}</title></head><body>
<header><div><a href='/'>{_text(2)}</a></div><p>{_text(5)}</p><h1>{_text(2)}</h1></header><nav>{_MENU}</nav><nav><p>{_text(4)}</p><div>{_text(3)}</div></nav>
{around}{open_main}{_main(k)}{inner}<footer><p>{_text(8)}</p></footer><form><p>{_text(6)}</p><label>{_text(3)}</label><button>{_text(1)}</button></form>{close_main}
<aside><h3>{_text(3)}</h3><p>{_text(14)}</p>{_MENU}</aside><form><label>{_text(3)}</label><button>{_text(2)}</button></form>
<dialog><p>{_text(9)}</p></dialog><menu><li>{_text(3)}</li></menu>
<footer><p>{_text(10)}</p><div>{_text(6)}</div>{_MENU}<small>{_text(5)}</small><address>{_text(6)}</address></footer></body></html>"""


def _pages() -> list[str]:
    opened = [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("", ""), ("<section>", "</section>")]
    opened += [(f"<div class='{n}'>", "</div>") for n in MAIN_NAMES] + [(f"<div id='{n.replace(' ', '-')}'>", "</div>") for n in MAIN_NAMES]
    return [_page(a, b, k, tuple(OTHER_NAMES[(k * 5 + i * 7) % len(OTHER_NAMES)] for i in range(12))) for k, (a, b) in enumerate(opened)]


LABELLED = _pages()
