"""Labelled training pages, composed by rule from hand-labelled fragments.

``data-main`` marks what belongs to the main text; everything else is menus, headers, footers, sidebars,
notices, adverts, forms and reader comments. Slots: ``{s}`` a sentence, ``{p}`` a paragraph, ``{t}`` a
title, ``{w}`` one or two words, ``{a}`` a link, ``{n}`` a number, ``{any}`` a class name that says nothing.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

MENUS = (
    "<nav><ul><li>{a}</li><li>{a}</li><li>{a}</li><li>{a}</li></ul></nav>",
    "<div class='menu'>{a} | {a} | {a}</div>",
    "<div id='navigation'><ul class='nav-list'><li>{a}<li>{a}<li>{a}<li>{a}<li>{a}</ul></div>",
    "<div role='navigation' class='{any}'><a href='#'>{w}</a> <a href='#'>{w}</a> <span>{w}</span></div>",
    "<ol class='breadcrumbs'><li>{a}</li><li>{a}</li><li>{w}</li></ol>",
    "<table class='navbar'><tr><td>{a}</td><td>{a}</td><td>{a}</td></tr></table>",
    "<div class='pagination'>{a} {a} <span>{n}</span> {a}</div>",
    "<ul class='{any}'><li>{a}</li><li>{a}</li><li>{a}</li><li>{a}</li><li>{a}</li><li>{a}</li></ul>",
    "<nav class='toc'><p>Contents</p><ol><li>{a}</li><li>{a}</li><li>{a}</li></ol></nav>",
)
HEADERS = (
    "<header><h1>{w}</h1><p>{t}</p></header>",
    "<div id='header'><a href='/'>{w}</a><div class='tagline'>{t}</div></div>",
    "<div class='masthead'><img src='l.png' alt=''>{w}</div>",
    "<header role='banner' class='{any}'><div>{a}</div><div>Log in</div><div>Sign up</div></header>",
    "<div class='top-bar'><span>{n}</span> <a href='/'>{w}</a></div>", "",
)
FOOTERS = (
    "<footer>&copy; {n} {w}. All rights reserved.</footer>",
    "<footer>&copy; {w} &middot; {s}</footer>", "<footer><p>{s}</p><p>{a} {a} {a}</p></footer>",
    "<div id='footer'><p>Copyright {n} {w}</p><ul><li>{a}</li><li>{a}</li></ul></div>",
    "<div class='site-footer'><div>{a}</div><div>{a}</div><div>{s}</div></div>",
    "<div class='{any}' role='contentinfo'>{w} {n}. {a} {a}</div>",
    "<div class='legal'>{s} {s}</div>", "<footer class='{any}'>{p}</footer>",
)
SIDEBARS = (
    "<aside><h3>{t}</h3><ul><li>{a}</li><li>{a}</li><li>{a}</li></ul></aside>",
    "<aside class='{any}'><p>{s}</p></aside>", "<aside>{p}</aside>",
    "<div class='sidebar'><h4>{w}</h4><p>{s}</p>{a}</div>",
    "<div id='right-column'><div class='widget'><h3>{w}</h3>{a}<br>{a}</div></div>",
    "<div class='related-posts'><h3>Related</h3><div>{a}</div><div>{a}</div></div>",
    "<section class='recommended'><h2>Read more</h2><p>{a}</p><p>{a}</p></section>",
    "<div class='author-bio'><p>{s}</p></div>",
)
NOTICES = (
    "<div class='cookie-notice'><p>We use cookies. {s}</p><button>Accept</button></div>",
    "<div id='cookie-banner'>{s} {a} <button>OK</button></div>", "<div class='consent'><p>{p}</p><button>Agree</button></div>",
    "<div class='alert'>{s}</div>", "<div class='notice' role='alert'>{s} {s}</div>", "<div class='popup modal'><p>{s}</p></div>",
    "<div role='dialog' class='{any}'><p>{s}</p><button>Close</button></div>", "<noscript>Enable scripts</noscript>",
    "<dialog open><p>{s}</p></dialog>", "<div class='paywall'>{s} <a href='#'>Subscribe</a></div>", "<div hidden>{s}</div>",
)
ADVERTS = (
    "<div class='ad'>{s}</div>", "<div class='ads'>{s} {s}</div>", "<div class='advert'><p>{p}</p></div>",
    "<div class='advertisement'>Advertisement<p>{s}</p></div>",
    "<div id='ad-{n}' class='{any}'>{s}</div>", "<aside class='sponsored'><p>Sponsored</p><p>{s}</p></aside>",
    "<div class='promo banner'>{t} {a}</div>", "<section class='promotion'>{s}</section>",
)
FORMS = (
    "<form><label>Name</label><input><label>Mail</label><input><button>Send</button></form>",
    "<form class='newsletter'><p>{s}</p><input type='email'><button>Subscribe</button></form>",
    "<div class='search'><form><input><button>Search</button></form></div>",
    "<form action='/poll'><p>{t}</p><label>{w}</label><label>{w}</label><select><option>{w}</select></form>",
    "<div class='signup'><p>{s}</p><button>Join</button></div>", "<fieldset><legend>{w}</legend>{w} <input></fieldset>",
)
COMMENTS = (
    "<section class='comments'><h2>{n} comments</h2><div class='comment'><b>{w}</b><p>{s}</p></div>"
    "<div class='comment'><b>{w}</b><p>{s} {s}</p></div></section>",
    "<div id='comments'><ul><li><p>{s}</p><a href='#'>Reply</a></li><li><p>{p}</p><a href='#'>Reply</a></li></ul></div>",
    "<ol class='comment-list'><li>{w}: {s}</li><li>{w}: {s}</li></ol>",
    "<div class='responses discussion'><h3>Responses</h3><p>{s}</p><p>{p}</p></div>",
    "<div class='reader-comments'><article class='comment'><p>{s}</p></article><article class='comment'><p>{p}</p></article></div>",
    "<div class='reviews'><h4>{w}</h4><p>{s}</p></div>",
)
SHARES = (
    "<div class='share'>{a} {a} {a}</div>", "<ul class='social'><li>{a}</li><li>{a}</li></ul>",
    "<div class='tags'>Tags: {a}, {a}</div>", "<div class='toolbar'><button>Print</button><button>Save</button></div>", "",
)
BODIES = (
    "<h1>{t}</h1><p>{p}</p><p>{p}</p><p>{s}</p>", "<h2>{t}</h2><p>{p}</p><h3>{w}</h3><p>{p}</p><ul><li>{s}</li><li>{w}</li></ul>",
    "<header><h1>{t}</h1></header><p>{p}</p><blockquote><p>{s}</p></blockquote><p>{p}</p>",
    "<p><b>{t}<br><p>{p}</p><p>{s}</p><p><b>{s}<br><p>{p}</p>", "<h1>{t}</h1>{p}<br><br>{p}<br>{s}",
    "<h1>{t}</h1><div>{p}</div><div>{s}</div><div>{p}</div>", "<h1>{t}</h1><p>{s}</p>", "<p>{w}.</p><p>{p}</p><p>{w}.</p>",
    "<h1>{t}</h1><p>{p}</p><pre>{s}</pre><dl><dt>{w}</dt><dd>{s}</dd></dl><p>{s} {a} {s}</p>",
    "<h1>{t}</h1><p>{p}</p><figure><img src='x'><figcaption>{s}</figcaption></figure><p>{p}</p>",
    "<h1>{t}</h1><table><tr><th>{w}</th><th>{n}</th></tr><tr><td>{w}</td><td>{n}</td></tr></table><p>{p}</p>",
    "<h1>{t}</h1><section><h2>{w}</h2><p>{p}</p></section><section><h2>{w}</h2><p>{p} {a}</p><ol><li>{s}</li></ol></section>",
)
HOLDERS = (
    ("<article data-main>", "</article>"), ("<main><article data-main>", "</article></main>"), ("<main data-main>", "</main>"),
    ("<div class='content' data-main>", "</div>"), ("<div id='main-content' class='{any}' data-main>", "</div>"),
    ("<div class='post entry' data-main>", "</div>"), ("<div class='article-body' data-main>", "</div>"),
    ("<div class='{any}' data-main>", "</div>"), ("<section class='story' data-main>", "</section>"),
    ("<div role='main' class='text' data-main>", "</div>"), ("<table class='{any}'><tr><td data-main>", "</td></tr></table>"),
    ("<article class='{any}' data-main>", "</article>"), ("<div data-main>", "</div>"), ("<section data-main>", "</section>"),
)
SENTENCES = (
    "The river rose in the night, and by morning the lower road was under water.", "Nobody had counted the boats before winter.",
    "It was agreed that the older plan, though slow, would cost less.", "She wrote back within a week, asking for two copies.",
    "Le marché ouvre à huit heures, mais les vendeurs arrivent bien avant.", "On ne sait pas encore quand la ligne sera réparée.",
    "Der Vorschlag wurde angenommen, obwohl einige Mitglieder fehlten.", "Das Haus steht seit vielen Jahren leer.",
    "La carta llegó tarde, y nadie supo explicar el motivo.", "Los resultados se publicarán en otoño.",
    "Prices fell for the third month in a row, the office said on Tuesday.", "What happens next depends on the weather!",
    "After the vote, the council adjourned until the first week of May.", "Several of the measurements, taken at sea, were later repeated.",
)
WORDS = ("Home", "News", "River", "Archive", "About", "Contact", "Politique", "Wirtschaft", "Cultura", "Travel", "Science", "Maps",
         "Region", "Editor", "Harbour", "Products", "Service", "Help", "Topics", "Anna K.", "Village", "Events")
CLASSES = ("c1", "row", "wrap", "container", "col", "x12", "inner", "box", "grid", "block", "module", "section", "l", "group")
SLOT = re.compile(r"\{(\w+)\}")


def _filled(fragment: str, pick: random.Random) -> str:
    def words(n: int) -> str:
        return " ".join(pick.choice(WORDS) for _ in range(n))

    def value(match: re.Match) -> str:
        slot = match.group(1)
        if slot == "s":
            return pick.choice(SENTENCES)
        if slot == "p":
            return " ".join(pick.choice(SENTENCES) for _ in range(pick.randint(2, 7)))
        if slot == "t":
            return pick.choice(SENTENCES).rsplit(",", 1)[0].rstrip(".!")
        if slot == "a":
            return f"<a href='/{pick.randint(1, 99)}'>{words(pick.randint(1, 3))}</a>"
        if slot == "n":
            return str(pick.randint(1, 2030))
        return pick.choice(CLASSES) if slot == "any" else words(pick.randint(1, 2))

    return SLOT.sub(value, fragment)


def labelled_pages(count: int, seed: int = 42) -> Iterator[str]:
    """``count`` pages in which ``data-main`` marks the main text."""
    pick = random.Random(seed)

    def some(kinds: tuple[tuple[str, ...], ...], chance: float) -> str:
        chosen = [pick.choice(kind) for kind in kinds if pick.random() < chance]
        pick.shuffle(chosen)
        return "".join(chosen)

    for _ in range(count):
        opened, closed = pick.choice(HOLDERS)
        bodies = [pick.choice(BODIES) for _ in range(pick.choice((1, 1, 2, 3)))]
        # what stands inside the main element without being main text
        inner = [some((SHARES, FORMS, COMMENTS, ADVERTS, SIDEBARS, NOTICES), 0.12) for _ in bodies]
        main = "".join(b + (f"<div data-other>{i}</div>" if i else "") for b, i in zip(bodies, inner))
        before = pick.choice(HEADERS) + some((MENUS, NOTICES, ADVERTS, FORMS), 0.45)
        after = some((COMMENTS, SIDEBARS, ADVERTS, SHARES, MENUS, FORMS, NOTICES), 0.4) + pick.choice(FOOTERS)
        page = opened + main + closed
        if pick.random() < 0.9:
            page = before + page + after
        elif pick.random() < 0.5:
            page = f"<section data-main>{main}</section>" if pick.random() < 0.5 else "<span data-main>{p}</span>"
        if pick.random() < 0.4:
            page = f"<div class='{{any}}'>{page}</div>"
        yield f"<!DOCTYPE html><html><head><title>{{t}}</title></head><body>{_filled(page, pick)}</body></html>".replace("{t}", "x")
