"""Labelled pages to learn from, composed of the parts that pages on the web are made of.

``data-label="1"`` marks an element as content, ``data-label="0"`` as something else; what is inside an
element has its label unless it has one of its own.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be co di el fo ga hu in jo ka le mi no or pa ri se ta un ve wi".split()


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.stop = "."

    def words(self, n: int) -> str:
        pick = self.random
        return " ".join("".join(pick.choices(_SYLLABLES, k=pick.randint(1, 4))) for _ in range(n))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.random.randint(1, 22)).capitalize() + self.stop for _ in range(n))

    def some(self, *options: str) -> str:
        return self.random.choice(options)

    def maybe(self, part: str, chance: float = 0.5) -> str:
        return part if self.random.random() < chance else ""

    def links(self, n: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{i}">{self.words(self.random.randint(1, 3))}</a></{item}>' for i in range(n))

    def menu(self) -> str:
        links = self.links(self.random.randint(3, 9))
        return self.some(
            f"<nav><ul>{links}</ul></nav>", f'<ul class="menu">{links}</ul>', f'<div id="main-nav"><ul>{links}</ul></div>',
            f'<div role="navigation">{self.links(4, "span")}</div>', f'<ol class="breadcrumb">{links}</ol>',
            f"<nav>{self.links(5, 'div')}</nav>",
        )

    def header(self) -> str:
        inside = self.some(f"<h1>{self.words(2)}</h1>", f"<p>{self.words(4)}</p>", f'<div class="logo">{self.words(2)}</div>')
        inside += self.maybe(f"<p>{self.sentences(1)}</p>") + self.maybe(self.menu())
        return self.some(
            f"<header>{inside}</header>", f'<div id="header">{inside}</div>', f'<div class="site-header">{inside}</div>',
            f'<div class="masthead">{inside}</div>',
        )

    def footer(self) -> str:
        inside = self.some(
            f"&copy; {self.words(3)} &middot; {self.sentences(1)}", f"<p>{self.sentences(2)}</p>",
            f"<ul>{self.links(4)}</ul><p>{self.words(6)}</p>",
        )
        return self.some(
            f"<footer>{inside}</footer>", f'<div id="footer">{inside}</div>', f'<div class="page-footer">{inside}</div>',
            f'<div class="copyright">{inside}</div>',
        )

    def side(self) -> str:
        inside = self.some(
            f"<h3>{self.words(2)}</h3><ul>{self.links(5)}</ul>", f"<h2>{self.words(2)}</h2><p>{self.sentences(3)}</p>",
            f"<p>{self.sentences(2)}</p>", self.sentences(1),
        )
        return self.some(
            f"<aside>{inside}</aside>", f'<div class="sidebar">{inside}</div>', f'<div id="side-bar">{inside}</div>',
            f'<aside class="widget">{inside}</aside>', f'<div class="right-rail">{inside}</div>',
            f'<div class="related">{inside}</div>', f'<section class="recommended">{inside}</section>',
        )

    def advert(self) -> str:
        inside = self.some(self.sentences(1), self.sentences(4), f"<p>{self.sentences(2)}</p>", f'<a href="/x">{self.words(5)}</a>')
        return self.some(
            f'<div class="ad">{inside}</div>', f'<div class="advert">{inside}</div>', f'<div id="ads-top">{inside}</div>',
            f'<section class="sponsored">{inside}</section>', f'<div class="promo">{inside}</div>',
            f'<aside class="advertisement">{inside}</aside>', f'<p class="ad">{self.sentences(1)}</p>',
        )

    def notice(self) -> str:
        inside = self.some(f"<p>{self.sentences(2)}</p><button>{self.words(1)}</button>", self.sentences(2), f"<p>{self.sentences(1)}</p>")
        return self.some(
            f'<div class="cookie-notice">{inside}</div>', f'<div class="notice">{inside}</div>', f'<div role="alert">{inside}</div>',
            f'<div id="consent">{inside}</div>', f'<p class="notice">{self.sentences(2)}</p>', f"<dialog>{inside}</dialog>",
            f'<section class="newsletter">{inside}</section>', f'<div class="disclaimer">{inside}</div>',
        )

    def form(self) -> str:
        return self.some(
            f"<form><label>{self.words(2)}</label><input name=q><button>{self.words(1)}</button></form>",
            f'<form class="search"><p>{self.sentences(1)}</p><input><select><option>{self.words(1)}<option>{self.words(2)}</select></form>',
            f'<div class="login"><form><p>{self.words(3)}</p><label>{self.words(1)}</label><input></form></div>',
        )

    def comments(self) -> str:
        n = self.random.randint(1, 5)
        talk = [f"<p>{self.sentences(self.random.randint(1, 6))}</p>" for _ in range(n)]
        return self.some(
            '<section class="comments"><h2>' + self.words(2) + "</h2>"
            + "".join(f"<article><h4>{self.words(1)}</h4>{t}</article>" for t in talk) + "</section>",
            '<div id="comments">' + "".join(f'<div class="comment">{t}</div>' for t in talk) + "</div>",
            '<ol class="comment-list">' + "".join(f"<li>{t}</li>" for t in talk) + "</ol>",
            '<div class="comments">' + "".join(talk) + "</div>",
            '<section id="reader-comments"><ul>' + "".join(f"<li>{self.words(2)}: {self.sentences(2)}</li>" for _ in talk) + "</ul></section>",
        )

    def other(self, part: str) -> str:
        """A part that isn't content, wherever it stands."""
        name = part[1:].split(">")[0].split()[0]
        return part.replace(f"<{name}", f'<{name} data-label="0"', 1)

    def block(self) -> str:
        n = self.random.randint(1, 9)
        return self.some(
            *[f"<p>{self.sentences(n)}</p>"] * 6, f"<p>{self.words(2).capitalize()}.</p>", f"<p><b>{self.sentences(n)}<br>",
            f"<h2>{self.words(4)}</h2>", f"<h3>{self.words(3)}</h3>", f"<blockquote><p>{self.sentences(2)}</p></blockquote>",
            "<ul>" + "".join(f"<li>{self.sentences(1)}</li>" for _ in range(n)) + "</ul>",
            "<ol>" + "".join(f"<li>{self.words(5)}</li>" for _ in range(n)) + "</ol>", f"<pre>{self.words(9)}</pre>",
            f"<p>{self.sentences(1)} <a href='/y'>{self.words(2)}</a> {self.sentences(1)}</p>", f"<div>{self.sentences(n)}</div>",
            f"<table><tr><th>{self.words(1)}<th>{self.words(2)}<tr><td>{self.words(1)}<td>{self.words(3)}</table>",
            f"<figure><img src=x><figcaption>{self.sentences(1)}</figcaption></figure>",
            f"<section><h2>{self.words(3)}</h2><p>{self.sentences(n)}</p><p>{self.sentences(2)}</p></section>",
        )

    def article(self) -> str:
        blocks = [self.maybe(f"<h1>{self.words(7)}</h1>", 0.8)]
        self.stop = self.some(".", ".", ".", ".", "", " |")  # texts without sentences are content, too
        if self.random.random() < 0.2:  # next to nothing, and the article all the same
            blocks = [self.some(f"<h1>{self.words(2)}.</h1>", "")] + [f"<p>{self.words(self.random.randint(1, 3))}.</p>"]
        else:
            blocks += [self.block() for _ in range(self.random.randint(1, 12))]
        for part in (self.advert, self.side, self.notice, self.form, self.menu):
            if self.random.random() < 0.12:
                blocks.insert(self.random.randint(1, len(blocks)), self.other(part()))
        inside = "".join(blocks)
        self.stop = "."
        return self.some(
            *[f'<article data-label="1">{inside}</article>'] * 3, f'<main data-label="1">{inside}</main>',
            f'<main><article data-label="1">{inside}</article></main>', f'<div data-label="1" id="content">{inside}</div>',
            f'<div data-label="1" class="post-body">{inside}</div>', f'<div data-label="1" class="entry-content">{inside}</div>',
            f'<section data-label="1" class="story">{inside}</section>', f'<div class="page"><div data-label="1" class="article">{inside}</div></div>',
            f'<div data-label="1">{inside}</div>', f'<article data-label="1" class="post"><div class="text">{inside}</div></article>',
        )

    def page(self) -> str:
        before = [self.maybe(x()) for x in (self.header, self.menu, self.notice, self.advert, self.form, self.side)]
        after = [self.maybe(x()) for x in (self.side, self.comments, self.advert, self.form, self.notice, self.menu)]
        body = "".join([*before, self.article(), *after, self.maybe(self.footer(), 0.8)])
        head = f"<head><title>{self.words(5)}</title><style>p{{}}</style><script>x('<p>')</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + self.maybe("</body></html>", 0.8)


def labelled_pages(n: int = 250, seed: int = 3) -> list[str]:
    """The same ``n`` labelled pages on every call."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(n)]
