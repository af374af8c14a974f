"""Labelled pages to train the HTML extractor on: a generator of invented pages whose
elements say by the attribute data-y whether they are main text (1) or not (0)."""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi no an er in on st re ti al".split()


class Pages:
    """A stream of invented pages; equal seeds give equal pages."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def phrase(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most))).capitalize()

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.phrase(4, 16) + self.r.choice(".....?!") for _ in range(self.r.randint(least, most)))

    def maybe(self, share: float) -> bool:
        return self.r.random() < share

    def named(self, *names: str) -> str:
        """class, id or both, or none."""
        n = self.r.choice(names)
        n = self.r.choice([n, n, f"site-{n}", f"{n}-box", f"{n} wide", f"page_{n}"])
        return self.r.choice([f' class="{n}"', f' class="{n}"', f' id="{n}"', f' class="{n}" id="{n}"'])

    def links(self, least: int, most: int) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase(1, 3)}</a>' for _ in range(self.r.randint(least, most))]
        if self.maybe(0.6):
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def menu(self) -> str:
        tag, name = self.r.choice([("nav", ""), ("nav", self.named("menu", "nav")), ("div", self.named("menu", "nav", "breadcrumbs", "navbar", "toc")), ("ul", self.named("menu", "nav"))])
        return f"<{tag}{name} data-y=0>{self.links(2, 9)}</{tag}>"

    def header(self) -> str:
        tag, name = self.r.choice([("header", ""), ("header", self.named("header", "masthead")), ("div", self.named("header", "masthead", "top", "logo"))])
        inside = self.r.choice([self.phrase(1, 4), f"<a href='/'>{self.phrase(1, 3)}</a>", f"<h1>{self.phrase(1, 4)}</h1><p>{self.phrase(2, 8)}</p>", f"<p>{self.sentences(1, 2)}</p>"])
        return f"<{tag}{name} data-y=0>{inside}{self.menu() if self.maybe(0.4) else ''}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(["div", "div", "section", "aside", "p"])
        name = self.named("cookie", "notice", "alert", "banner", "consent", "newsletter", "popup", "modal", "subscribe", "warning", "message")
        inside = self.sentences(1, 3)
        if self.maybe(0.1):
            return f"<noscript data-y=0>{self.phrase(2, 6)}.</noscript>"
        if tag != "p":
            inside = self.r.choice([inside, f"<p>{inside}</p>"]) + ("<button>Ok</button>" if self.maybe(0.4) else "")
        return f"<{tag}{name} data-y=0>{inside}</{tag}>"

    def advert(self) -> str:
        tag = self.r.choice(["div", "div", "div", "aside", "section", "ins"])
        name = self.named("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner")
        inside = self.r.choice([self.phrase(2, 8), self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f"<a href='/x'>{self.phrase(2, 7)}</a>"])
        return f"<{tag}{name} data-y=0>{inside}</{tag}>"

    def side(self) -> str:
        tag, name = self.r.choice([("aside", ""), ("aside", self.named("sidebar", "related")), ("div", self.named("sidebar", "related", "widget", "rail", "recommended", "popular", "share", "social", "tags"))])
        inside = self.r.choice([self.links(2, 8), f"<h3>{self.phrase(1, 3)}</h3>{self.links(2, 6)}", f"<p>{self.sentences(1, 3)}</p>", f"<h2>{self.phrase(1, 3)}</h2><p>{self.sentences(1, 2)}</p>"])
        return f"<{tag}{name} data-y=0>{inside}</{tag}>"

    def comments(self) -> str:
        tag, name = self.r.choice(["section", "div", "ol"]), self.named("comments", "comment-list", "responses", "discussion", "replies")
        one = self.r.choice(["div", "article", "li"]) if tag != "ol" else "li"
        items = "".join(f"<{one}{self.named('comment', 'reply')}><p>{self.sentences(1, 4)}</p></{one}>" for _ in range(self.r.randint(1, 4)))
        if tag != "ol" and self.maybe(0.4):  # no element for each
            items = "".join(f"<p>{self.sentences(1, 4)}</p>" for _ in range(self.r.randint(1, 3)))
        return f"<{tag}{name} data-y=0>" + (f"<h3>{self.phrase(1, 2)}</h3>" if self.maybe(0.5) else "") + items + f"</{tag}>"

    def form(self) -> str:
        return f"<form action='/x' data-y=0><label>{self.phrase(1, 4)}</label><input type=text><select><option>{self.word()}<option>{self.word()}</select><textarea>{self.phrase(1, 5)}</textarea><button>{self.phrase(1, 2)}</button>{'<p>' + self.sentences(1, 2) + '</p>' if self.maybe(0.4) else ''}</form>"

    def footer(self) -> str:
        tag, name = self.r.choice([("footer", ""), ("footer", self.named("footer")), ("div", self.named("footer", "copyright", "legal", "bottom"))])
        inside = self.r.choice([f"&copy; {self.phrase(1, 4)} &middot; {self.sentences(1, 2)}", f"<p>&copy; {self.phrase(2, 6)}</p>", self.links(2, 6), f"<p>{self.sentences(1, 2)}</p>"])
        return f"<{tag}{name} data-y=0>{inside}</{tag}>"

    def paragraph(self) -> str:
        text = self.sentences(1, 7) if self.maybe(0.8) else self.phrase(1, 5) + self.r.choice([".", "", "!!", " ### %%%"])
        if self.maybe(0.3):
            text = f"<{'b' if self.maybe(0.5) else 'em'}>{self.phrase(1, 4)}</b> {text}"
        if self.maybe(0.2):
            text += f' <a href="/{self.word()}">{self.phrase(1, 4)}</a> {self.phrase(1, 6)}.'
        if self.maybe(0.2):
            text += f"<br>{self.sentences(1, 2)}"
        return self.r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"])

    def body(self) -> str:
        title = f"<h1>{self.phrase(2, 9)}</h1>"
        parts = [f"<header>{title}</header>" if self.maybe(0.15) else title] if self.maybe(0.8) else []
        terse = self.maybe(0.2)  # many short, alike paragraphs
        for _ in range(self.r.choice([8, 20, 40] if terse else [1, 1, 2, 3, 4, 6, 9, 15])):
            kind = self.r.random()
            if terse:
                text = self.r.choice([self.phrase(1, 4) + ".", self.phrase(1, 2), parts[-1][3:-4] if parts else "x", self.word() * 2 + " " + self.word()])
                parts.append(f"<p>{text}</p>")
            elif kind < 0.78:
                parts.append(self.paragraph())
            elif kind < 0.83:
                parts.append(f"<h2>{self.phrase(1, 6)}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif kind < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.phrase(1, 3)}</td></tr>" for _ in range(self.r.randint(2, 4))) + "</table>")
            elif kind < 0.96:
                parts.append(f"<pre>{self.phrase(3, 12)}</pre>")
            else:
                parts.append(f"<figure><img src=x><figcaption>{self.phrase(3, 9)}</figcaption></figure>")
        for extra in (self.advert, self.side, self.notice, self.form, self.comments):
            if self.maybe(0.08):
                parts.insert(self.r.randint(1, len(parts)), extra())
        if len(parts) > 1 and self.maybe(0.3):  # a plain element around some of it
            k, tag = self.r.randrange(len(parts)), self.r.choice(["section", "div", "div"])
            parts[k:] = [f"<{tag}>{''.join(parts[k:])}</{tag}>"]
        return "".join(parts)

    def page(self) -> str:
        tag, name = self.r.choice([("article", ""), ("article", ""), ("article", self.named("post", "entry")), ("main", ""), ("main", self.named("content")), ("div", self.named("content", "post", "article", "entry", "story", "main", "text")), ("section", self.named("content", "post", "article"))])
        bare = self.maybe(0.06)  # no element of its own for the main text
        out = self.body() if bare else f"<{tag}{name} data-y=1>{self.body()}</{tag}>"
        if tag == "article" and not bare and self.maybe(0.3):
            out = f"<main>{out}{self.comments() if self.maybe(0.4) else ''}</main>"
        for make, share in ((self.comments, 0.45), (self.side, 0.4), (self.form, 0.25), (self.advert, 0.3), (self.footer, 0.8)):
            if self.maybe(share):
                out += make()
        for make, share in ((self.side, 0.15), (self.advert, 0.4), (self.notice, 0.35), (self.menu, 0.7), (self.header, 0.5)):
            if self.maybe(share):
                out = make() + out
        if not bare and self.maybe(0.3):
            out = f"<div{self.named('wrapper', 'container', 'page', 'layout')}>{out}</div>"
        head = f'<head><meta charset="utf-8"><title>{self.phrase(2, 7)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        return f"<!DOCTYPE html><html>{head}<body data-y={int(bare)}>{out}</body></html>"
