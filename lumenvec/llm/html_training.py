"""Labelled pages to train the extraction on, drawn from a grammar of page layouts.

No labelled pages come with the tables, so these are made: layouts of five families (HTML 5 sections, boxes known by their
classes, boxes known by their ids, tables, bare pages), each with or without menus, banners, sidebars, adverts, notices, forms, related
links, comments and footers, in markup that is partly left unclosed. An element carries ``data-label``, content or boilerplate,
and its descendants inherit it; a user's own labelled pages take the same form. Words are random syllables, so that no
vocabulary is learnt.
"""

from __future__ import annotations

import random
from collections.abc import Callable

LABEL = "data-label"
FAMILIES = ("sections", "classes", "ids", "tables", "bare")
_SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to".split()


class _Writer:
    def __init__(self, rng: random.Random, family: str):
        self.rng, self.family = rng, family
        self.loose = rng.random() < 0.4  # leaves paragraphs and items open

    def maybe(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 22).capitalize() + self.rng.choice("....?!") for _ in range(self.rng.randint(low, high)))

    def tag(self, name: str, body: str, label: str = "", **attributes: str) -> str:
        a = "".join(f' {k.rstrip("_")}="{v}"' for k, v in attributes.items() if v)
        return f"<{name}{a}{f' {LABEL}={label!r}' if label else ''}>{body}</{name}>"

    def box(self, section: str, names: str, body: str, label: str = "") -> str:
        """A part of the page: by its tag in one family, by its class or id in others, by nothing in a few."""
        name = self.rng.choice(names.split())
        if self.family in ("sections", "bare"):
            return self.tag(section, body, label, class_=name if self.maybe(0.4) else "")
        kind = "div" if self.maybe(0.85) else "section"
        return self.tag(kind, body, label, **({"class_": name if self.maybe(0.7) else f"site-{name} box"} if self.family != "ids" else {"id": name}))

    def links(self, low: int, high: int, words: int = 3) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, words)}</a>' for _ in range(self.rng.randint(low, high))]
        if self.maybe(0.7):
            return "<ul>" + "".join(f"<li>{x}" if self.loose else f"<li>{x}</li>" for x in items) + "</ul>"
        return self.rng.choice([" | ", " ", " &middot; "]).join(items)

    def paragraph(self, low: int = 1, high: int = 6) -> str:
        text = self.words(1, 4).capitalize() + "." if self.maybe(0.15) else self.sentences(low, high)
        if self.maybe(0.06):  # an article may hold anything: lists in a line, codes, shouting
            text = self.rng.choice([" | ", " &middot; ", ", ", " # "]).join(self.words(1, 2) for _ in range(self.rng.randint(3, 40)))
        elif self.maybe(0.08):  # no sentence at all, or one word again and again
            text = self.words(1, 60) if self.maybe(0.6) else " ".join([self.words(1, 1)] * self.rng.randint(2, 80))
        elif self.maybe(0.03):
            text = text.upper() + " &copy; " + "".join(self.rng.choices("0123456789-/", k=self.rng.randint(4, 40)))
        for name in ("b", "em", "a"):
            if self.maybe(0.12):
                words = text.split(" ")
                at = self.rng.randrange(len(words))
                words[at] = f'<a href="#">{words[at]}</a>' if name == "a" else f"<{name}>{words[at]}</{name}>"
                text = " ".join(words)
        if self.maybe(0.06):
            return f"<p><b>{text}<br>"
        return f"<p>{text}" + ("" if self.loose and self.maybe(0.5) else "</p>")

    # what the article holds

    def article(self) -> str:
        r, parts = self.rng, []
        title = self.tag(r.choice(["h1", "h1", "h2"]), self.words(2, 10).capitalize())
        parts.append(self.tag("header", title) if self.family == "sections" and self.maybe(0.3) else title)
        for _ in range(0 if self.maybe(0.06) else r.randint(1, 12)):
            kind = r.random()
            if kind < 0.72:
                parts.append(self.paragraph())
            elif kind < 0.8:
                parts.append(self.tag(r.choice(["h2", "h3", "h4"]), self.words(1, 7).capitalize()))
            elif kind < 0.86:
                parts.append(self.tag(r.choice(["ul", "ol"]), "".join(f"<li>{self.sentences(1, 1)}</li>" for _ in range(r.randint(2, 6)))))
            elif kind < 0.9:
                parts.append(self.tag("blockquote", self.paragraph(1, 3)))
            elif kind < 0.93:
                parts.append(self.tag("pre", self.words(3, 30)))
            elif kind < 0.96:
                parts.append(self.tag("table", "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5)))))
            else:
                parts.append(self.tag("figure", '<img src="x.png">' + self.tag("figcaption", self.words(3, 12))))
        for p, extra in ((0.15, self.advert), (0.12, self.notice), (0.12, self.share), (0.1, self.form), (0.12, self.related), (0.15, self.comments)):
            if self.maybe(p):
                parts.insert(len(parts) if extra in (self.comments, self.related, self.share) else r.randint(1, len(parts)), extra())
        return "".join(parts)

    # what it doesn't

    def menu(self) -> str:
        return self.box("nav", "nav menu navbar navigation breadcrumbs", self.links(3, 12), "boilerplate")

    def header(self) -> str:
        inner = self.tag(self.rng.choice(["h1", "div", "p", "span"]), self.words(1, 5)) + (self.menu() if self.maybe(0.4) else "") + (f"<p>{self.words(2, 10)}</p>" if self.maybe(0.4) else "")
        return self.box("header", "header masthead banner topbar", inner, "boilerplate")

    def footer(self) -> str:
        inner = "&copy; " + self.words(1, 3) + (" &middot; " + self.sentences(0, 4) if self.maybe(0.7) else "") + (self.links(2, 8) if self.maybe(0.5) else "") + (self.paragraph() if self.maybe(0.3) else "")
        return self.box("footer", "footer colophon copyright bottom", inner, "boilerplate")

    def sidebar(self) -> str:
        inner = "".join(self.tag("h3", self.words(1, 3)) + self.rng.choice([self.links(2, 8, 8), self.paragraph(1, 3), self.tag("div", self.sentences(1, 2))]) for _ in range(self.rng.randint(1, 4)))
        return self.box("aside", "sidebar widget rail aside secondary", inner, "boilerplate")

    def advert(self) -> str:
        inner = self.rng.choice([self.sentences(1, 3), self.paragraph(1, 3), self.links(1, 3, 8), self.words(2, 12)])
        return self.tag(self.rng.choice(["div", "div", "aside", "section"]), inner, "boilerplate", **{self.rng.choice(["class_", "class_", "id"]): self.rng.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement", "ad banner"])})

    def notice(self) -> str:
        inner = self.rng.choice([f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 2)]) + (self.tag("button", self.words(1, 2)) if self.maybe(0.5) else "")
        return self.tag(self.rng.choice(["div", "div", "aside", "section", "dialog"]), inner, "boilerplate", **{self.rng.choice(["class_", "id", "role"]): self.rng.choice(["cookie-notice", "consent", "notice", "alert", "popup", "gdpr-overlay", "notification"])})

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input><p>{self.words(2, 10)}</p>" + self.tag("button", self.words(1, 2))
        return self.tag("form", inner, "boilerplate", class_=self.rng.choice(["", "search", "newsletter", "login", "contact-form"]))

    def share(self) -> str:
        return self.tag("div", self.links(2, 5, 2), "boilerplate", class_=self.rng.choice(["share", "social", "sharing buttons", "share-bar"]))

    def related(self) -> str:
        return self.box("aside", "related recommended popular teasers more", self.tag("h3", self.words(1, 3)) + self.links(2, 6, 10), "boilerplate")

    def comments(self) -> str:
        one = lambda: self.tag(self.rng.choice(["div", "article", "li"]), self.tag("span", self.words(1, 2)) + self.paragraph(1, 4), class_=self.rng.choice(["comment", "reply", "comment-body", ""]))
        inner = self.tag("h3", self.words(1, 3)) + "".join(one() for _ in range(self.rng.randint(1, 7))) + (self.form() if self.maybe(0.4) else "")
        return self.tag(self.rng.choice(["div", "section", "ol"]), inner, "boilerplate", **{self.rng.choice(["class_", "id"]): self.rng.choice(["comments", "discussion", "commentlist", "respond", "reader-comments"])})

    def page(self) -> str:
        some: Callable = lambda p, part: part() if self.maybe(p) else ""
        body = self.article()
        if self.family in ("sections", "bare"):
            article = self.tag("article", body, "content", class_=self.rng.choice(["", "", "post", "story"]))
            if self.family == "sections" and self.maybe(0.6):
                article = self.tag("main", article + some(0.2, self.comments))
        else:
            name = self.rng.choice(["content", "post", "article-body", "entry-content", "story", "main-content", "text"])
            article = self.tag("div", body, "content", **({"id": name} if self.family == "ids" else {"class_": name}))
            if self.maybe(0.5):
                article = self.tag("div", article + some(0.2, self.comments), **({"id": "main"} if self.family == "ids" else {"class_": self.rng.choice(["wrapper", "container", "main", "page"])}))
        side = some(0.45, self.sidebar)
        if self.family == "tables" and self.maybe(0.7):
            middle = self.tag("table", self.tag("tr", self.tag("td", side or self.links(3, 8), "boilerplate") + self.tag("td", article)))
        else:
            middle = side + article if self.maybe(0.4) else article + side
        top = some(0.3, self.notice) + some(0.55, self.header) + some(0.7, self.menu) + some(0.4, self.advert) + some(0.15, self.form)
        end = some(0.2, self.related) + some(0.25, self.comments) + some(0.2, self.advert) + some(0.8, self.footer) + some(0.15, self.notice)
        head = f"<head><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{top}{middle}{end}</body></html>"


def labelled_pages(n: int, seed: int = 1, families: tuple[str, ...] = FAMILIES) -> list[str]:
    """``n`` pages, the families in turn; equal arguments give equal pages."""
    return [_Writer(random.Random(f"{seed}:{k}"), families[k % len(families)]).page() for k in range(n)]
