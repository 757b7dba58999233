"""Labelled pages that the HTML extractor is trained on, drawn by a seeded generator.

y="1" and y="0" label an element and what is below it; the page itself is 0. Layout, tags, class words, order and lengths vary at random, and
many elements have no class, or one that says nothing, so that a model can't lean on names alone."""

from __future__ import annotations

import random

#: Pages to train on; other seeds give pages to hold out.
PAGES = 800

# Words that classes and ids are made of, by what they mark.
NAMES = {
    "main": "content main post entry article body story text page-content post-body entry-content article-body main-content blog-post prose hentry".split(),
    "menu": "nav menu navbar navigation topnav main-menu site-nav breadcrumb breadcrumbs pagination toc tabs toolbar pager links".split(),
    "header": "header site-header masthead top topbar banner-top branding logo page-header".split(),
    "footer": "footer site-footer bottom copyright colophon legal footer-links imprint credits".split(),
    "side": "sidebar aside side widget widgets rail secondary column-right panel".split(),
    "notice": "cookie cookies notice alert consent gdpr warning message popup modal paywall disclaimer announcement banner".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion banner-ad adsense commercial teaser-ad outbrain".split(),
    "related": "related recommended more-stories read-more also popular trending most-read see-also teasers latest".split(),
    "share": "share social sharing follow share-buttons social-links tweet like-button tags meta byline-links".split(),
    "form": "newsletter subscribe signup search login form contact-form search-form subscription register".split(),
    "comments": "comments comment responses response replies reply discussion reactions feedback disqus respond thread guestbook conversation reader-comments user-comments commentlist opinions".split(),
}
HEADS = {
    "comments": ["Comments", "Responses", "Replies", "Discussion", "Reader comments", "Leave a reply", "What readers say", "Kommentare", "Commentaires", "Comentarios"],
    "related": ["Related", "More stories", "Read also", "Popular", "Most read", "You may like", "Recommended"],
    "side": ["About me", "Archive", "Categories", "Popular", "Links", "Tags"],
    "form": ["Subscribe", "Newsletter", "Search", "Sign up", "Log in"],
    "share": ["Share", "Follow us"],
    "footer": ["Contact", "Imprint", "Legal"],
}
NEUTRAL = "wrap wrapper container inner outer row col box block region layout grid section-a css-1x2 x7 root app page site wide center group".split()
SYLLABLES = "an ba ce do en er fa ge hi in ka le lo ma ne no or pa qu ra re sa si ta te ti un ve wo zu é ü ñ sch tion ing eau".split()


class Draw:
    """One page, drawn from a random generator."""

    def __init__(self, r: random.Random):
        self.r, self.bare = r, False

    def some(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def sentence(self) -> str:
        text = self.words(1, self.r.choice((8, 18, 18, 50)))
        if self.some(0.15):
            text += f", {self.word()} &amp; {self.word()}"
        return text + self.r.choice("....?!")

    def sentences(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def attribute(self, kind: str, named: float = 0.55) -> str:
        """A class or id that tells the kind, one that tells nothing, or none."""
        x = self.r.random()
        if x < named:
            names = [self.r.choice(NAMES[kind])] + ([self.r.choice(NEUTRAL)] if self.some(0.3) else [])
        elif x < named + 0.15:
            names = [self.r.choice(NEUTRAL)]
        else:
            return ""
        return f' {self.r.choice(("class", "class", "id"))}="{" ".join(names)}"'

    def element(self, tag: str, attribute: str, inner: str, y: int | None = None) -> str:
        label = "" if y is None else f' y="{y}"'
        return f"<{tag}{attribute}{label}>{inner}</{tag}>"

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(0, 999)}">{self.words(low, high)}{self.r.choice(".,?") if self.some(0.15) else ""}</a>'

    # ------------------------------------------------------------ content
    def inline(self) -> str:
        parts = [self.sentences(1, 3)]
        for _ in range(self.r.randint(0, 3)):
            tag = self.r.choice(("a", "b", "em", "i", "strong", "code", "span"))
            parts += [f"<{tag}{' href=/x' if tag == 'a' else ''}>{self.words(1, 4)}</{tag}>", self.sentences(1, 2)]
        return " ".join(parts)

    def block(self) -> str:
        if self.some(0.12):
            return f"<p>{self.sentences(8, 60)}</p>"
        kind = self.r.choices(("p", "short", "open", "list", "head", "quote", "pre", "table", "figure", "terms", "bare", "div"), (40, 8, 5, 6, 8, 4, 2, 3, 2, 2, 3, 4))[0]
        if kind == "p":
            return f"<p>{self.inline()}</p>"
        if kind == "short":
            return f"<p>{self.words(1, 4)}{self.r.choice(('.', '', '?'))}</p>"
        if kind == "open":
            return f"<p><b>{self.sentence()}<br><p>{self.inline()}"
        if kind == "list":
            tag = self.r.choice(("ul", "ol"))
            items = [self.words(2, 9) if self.some(0.5) else self.sentences(1, 2) if self.some(0.8) else self.link(1, 5) for _ in range(self.r.randint(2, 6))]
            return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{tag}>"
        if kind == "head":
            tag = self.r.choice(("h2", "h2", "h3", "h4"))
            return f"<{tag}>{self.words(1, 8)}</{tag}><p>{self.inline()}</p>"
        if kind == "quote":
            return f"<blockquote>{self.inline()}</blockquote>" if self.some(0.5) else f"<blockquote><p>{self.inline()}</p></blockquote>"
        if kind == "pre":
            return f"<pre>{self.words(3, 12)}\n  {self.words(2, 9)}</pre>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 4))) + "</table>"
        if kind == "figure":
            return f'<figure><img src="a.png"><figcaption>{self.sentence()}</figcaption></figure>'
        if kind == "terms":
            return "<dl>" + "".join(f"<dt>{self.words(1, 2)}</dt><dd>{self.sentence()}</dd>" for _ in range(2)) + "</dl>"
        if kind == "div":
            return f"<div>{self.inline()}</div>"
        return f"{self.inline()}<br><br>{self.sentences()}"

    def title(self) -> str:
        tag = self.r.choice(("h1", "h1", "h1", "h2"))
        return f"<{tag}>{self.words(1, 9)}{self.r.choice(('', '', '.'))}</{tag}>"

    def content(self) -> str:
        """An article: in an element of any kind, or as blocks right in the page."""
        parts = [self.title()] if self.some(0.8) else []
        parts += [self.block() for _ in range(self.r.choice((1, 1, 2, 2, 3, 4, 6, 9)))]
        if self.some(0.5):
            for _ in range(self.r.randint(1, 2)):
                kind = self.r.choice(("ad", "share", "related", "side", "form", "notice"))
                parts.insert(self.r.randint(1 if len(parts) > 1 else 0, len(parts)), self.clutter(kind, 0))
        if self.some(0.25):
            parts.append(self.clutter("comments", 0))
        tag = self.r.choices(("article", "div", "section", "main", "td", ""), (23, 32, 11, 11, 6, 22))[0]
        if not tag:  # nothing but the page's body holds the blocks together
            self.bare = True
            return "".join(parts)
        around = self.r.choice((0, 0, 1, 2)) if tag != "td" else 0
        body = self.element(tag, self.attribute("main", 0.35), "".join(parts), None if around else 1)
        if tag == "td":
            return f"<table><tr>{self.element('td', '', self.clutter('menu')) if self.some(0.2) else ''}{body}</tr></table>"
        for k in range(around):
            body = self.element("div", self.attribute("main", 0.1), body, 1 if k == around - 1 else None)
        return body

    # ------------------------------------------------------------ everything else
    def head_of(self, kind: str, p: float) -> str:
        if kind not in HEADS or not self.some(p):
            return ""
        tag = self.r.choice(("h2", "h3", "h4", "h3", "strong"))
        return f"<{tag}>{self.r.choice(HEADS[kind])}</{tag}>"

    def links(self, low: int, high: int, words: int = 2) -> str:
        items = [self.link(1, words) for _ in range(self.r.randint(low, high))]
        way = self.r.random()
        if way < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice((" ", " | ", " &middot; ")).join(items)

    def clutter(self, kind: str, y: int | None = None) -> str:
        r = self.r
        tag, inner = "div", ""
        named = 0.65
        if kind == "menu":
            tag = r.choice(("nav", "nav", "div", "ul"))
            inner = self.links(3, 9) if tag != "ul" else "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(3, 8)))
            named = 0.4
        elif kind == "header":
            tag = r.choice(("header", "header", "div"))
            inner = f"<a href='/'>{self.words(1, 3)}</a>" + (f"<p>{self.words(2, 6)}</p>" if self.some(0.4) else "") + (self.clutter("menu") if self.some(0.5) else "")
        elif kind == "footer":
            tag = r.choice(("footer", "footer", "div"))
            inner = self.head_of(kind, 0.1) + r.choice(("&copy; ", "&copy; example.com &middot; ", "Copyright ", "")) + (self.sentence() if self.some(0.6) else self.words(2, 8)) + (self.links(2, 5) if self.some(0.5) else "")
            named = 0.65 if tag == "div" else 0.3
        elif kind == "side":
            tag = r.choice(("aside", "aside", "div"))
            inner = self.head_of(kind, 0.7) + (f"<p>{self.sentences(1, 3)}</p>" if self.some(0.5) else "") + self.links(2, 6, 6)
            named = 0.85 if tag == "div" else 0.4
        elif kind == "notice":
            inner = (f"<p>{self.sentences(1, 2)}</p>" if self.some(0.5) else self.sentences(1, 2)) + (f"<button>{self.words(1, 2)}</button>" if self.some(0.6) else "")
            named = 0.95
        elif kind == "ad":
            tag = r.choice(("div", "div", "aside", "section"))
            inner = f"<p>{self.sentences(1, 3)}</p>" if self.some(0.4) else self.sentence() if self.some(0.8) else self.link(2, 5)
            named = 0.97
        elif kind == "related":
            tag = r.choice(("div", "section", "aside"))
            inner = self.head_of(kind, 0.8) + self.links(2, 5, 8) + (f"<p>{self.sentence()}</p>" if self.some(0.2) else "")
        elif kind == "share":
            inner = self.head_of(kind, 0.4) + " ".join(self.link(1, 1) for _ in range(r.randint(2, 5)))
        elif kind == "form":
            tag = r.choice(("form", "form", "div"))
            inner = self.head_of(kind, 0.5) + f"<label>{self.words(1, 4)}</label><input type=text>" + (f"<select><option>{self.words(1, 1)}</option></select>" if self.some(0.2) else "") + f"<button>{self.words(1, 2)}</button>"
            if tag == "div":
                inner = f"<form>{inner}</form>" + (f"<p>{self.sentence()}</p>" if self.some(0.5) else "")
        elif kind == "comments":
            tag = r.choice(("div", "section", "div", "ol"))
            titled = self.some(0.75) and tag != "ol"
            each, by = r.choice(("div", "li", "div", "div", "li", "article")) if tag != "ol" else "li", r.choice(("b", "span", "p", "strong", "cite"))
            own = self.attribute("comments", 0.5)
            items = "".join(self.element(each, own, f"<{by}>{self.words(1, 2)}</{by}>" * self.some(0.7) + f"<p>{self.sentences(1, 3)}</p>") for _ in range(r.randint(1, 5)))
            inner = (self.head_of(kind, 1.0) if titled else "") + (f"<ul>{items}</ul>" if each == "li" and tag != "ol" else items)
            inner += f"<form><textarea>{self.word()}</textarea><button>{self.words(1, 2)}</button></form>" if self.some(0.4) else ""
            named = 0.7 if titled else 1.0
        return self.element(tag, self.attribute(kind, named), inner, y)

    def page(self) -> str:
        if self.some(0.07):  # nothing but paragraphs
            title = self.title() if self.some(0.5) else ""
            return self.element("body", "", title + "".join(f"<p>{self.inline()}</p>" for _ in range(self.r.randint(1, 8))), 1)
        if self.some(0.09):  # a short piece, with or without a remark
            inner = "".join(f"<p>{self.sentences(1, 2)}</p>" for _ in range(self.r.randint(1, 3))) + (self.clutter("comments", 0) if self.some(0.3) else "")
            return self.element(self.r.choice(("article", "article", "div", "section", "main")), self.attribute("main", 0.2), inner, 1)
        before = [k for k, p in (("header", 0.5), ("menu", 0.7), ("notice", 0.3), ("ad", 0.5), ("form", 0.15), ("side", 0.15)) if self.some(p)]
        after = [k for k, p in (("share", 0.2), ("comments", 0.3), ("related", 0.3), ("ad", 0.2), ("side", 0.3), ("form", 0.2), ("menu", 0.2), ("footer", 0.75)) if self.some(p)]
        if self.some(0.28):
            before, after = [], []
        middle = "".join(self.content() for _ in range(self.r.choice((1, 1, 1, 1, 2))))
        own = 0 if self.bare else None
        body = "".join(self.clutter(k, own) for k in before) + middle + "".join(self.clutter(k, own) for k in after)
        if not self.bare and self.some(0.33):
            body = self.element("div", self.attribute("main", 0.0), body)
        body = self.element("body", "", body, 1 if self.bare else None)
        head = f"<head><meta charset=utf-8><title>{self.words(1, 6)}</title><style>p{{}}</style></head>"
        return f"<!DOCTYPE html><html>{head}{body}</html>" if self.some(0.75) else body


def labelled_pages(n: int = PAGES, seed: int = 8) -> list[str]:
    r = random.Random(seed)
    return [Draw(r).page() for _ in range(n)]
