"""Made-up pages whose blocks are labelled by construction: what the block classifier is fitted to.

A page is an article in one of many layouts with boilerplate around and inside it:
menus, headers, footers, sidebars, notices, adverts, forms, related links and reader
comments. Elements, class names, lengths and nesting are drawn by a seeded generator,
so any number of pages can be made, and pages of other seeds are held out.
"""

from __future__ import annotations

import random

#: Parts of class and id names by what holds them.
NAMES = {
    "content": "article content post entry story body text blog prose main page news single detail".split(),
    "nav": "nav navbar navigation navi menu breadcrumb breadcrumbs pagination pager toolbar tabs".split(),
    "header": "header masthead topbar top banner logo branding".split(),
    "footer": "footer foot copyright legal disclaimer bottom imprint".split(),
    "sidebar": "sidebar side aside rail widget widgets column".split(),
    "ad": "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion promoted".split(),
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay banner privacy".split(),
    "comments": "comment comments disqus reply replies respond discussion reactions feedback thread".split(),
    "form": "form newsletter subscribe subscription signup login register search contact".split(),
    "share": "share sharing social related recommended recommendation more follow tags popular".split(),
}
#: Words that stand beside those names and tell nothing.
NEUTRAL = "site box wrap wrapper container inner outer list item block area section module left right row col grid panel card view item1 bar".split()
#: What articles are about; some are names of boilerplate elsewhere.
TOPICS = "policy legal social search travel sport health notice comment contact side top privacy related alert market science register".split()
SYLLABLES = "an the er in on at re th ed nd ha en to it or es of is wh sh ly ou st ing ion ble ter men cor val que der sch ung ción ado mente eau eux".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.truth: list[tuple[str, int]] = []

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(max(1, n)))

    def sentence(self, n: int) -> str:
        return self.words(n).capitalize() + self.r.choice((".", ".", ".", "!", "?", ""))

    def prose(self, n: int) -> str:
        out = []
        while n > 0:
            k = min(n, self.r.randint(4, 18))
            out.append(self.sentence(k))
            n -= k
        return " ".join(out)

    def attributes(self, kind: str | None, much: float = 0.75) -> str:
        """class and id, or none."""
        if kind is None or self.r.random() > much:
            return self.r.choice(("", "", f' class="{self.r.choice(NEUTRAL)}"'))
        parts = [self.r.choice(NAMES[kind])]
        if self.r.random() < 0.4:
            parts.insert(self.r.randint(0, 1), self.r.choice(NEUTRAL))
        name = self.r.choice("-_").join(parts)
        if kind == "content" and self.r.random() < 0.25:
            name += f"{self.r.choice((' ', '-'))}{self.r.choice(TOPICS)}"
        if self.r.random() < 0.3:
            name += f" {self.r.choice(NEUTRAL)}"
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def block(self, tag: str, text: str, label: int, attributes: str = "", linked: float = 0.0) -> None:
        shown = f"<a href='#'>{text}</a>" if self.r.random() < linked else text
        if self.r.random() < 0.1 and not linked:
            k = self.r.randint(0, len(text) // 2)
            at = text.find(" ", k)
            if at > 0:
                shown = f"{text[:at]} <{(t := self.r.choice(('b', 'em', 'a', 'i')))}>{text[at + 1 :]}</{t}>"
        shown = f"<{tag}{attributes}>{shown}</{tag}>"
        self.out.append(f"<div>{shown}</div>" if tag in ("span", "label", "b") else shown)
        self.truth.append((text, label))

    def wrapped(self, tag: str, attributes: str, inside) -> None:
        self.out.append(f"<{tag}{attributes}>")
        inside()
        self.out.append(f"</{tag}>")

    def links(self, kind: str, n: int) -> None:
        self.wrapped("ul", self.attributes(kind, 0.3), lambda: [self.block("li", self.words(self.r.randint(1, 7 if kind == "share" else 3)), 0, "", 0.93) for _ in range(n)])

    def boilerplate(self, kind: str) -> None:
        r = self.r
        tag = {"nav": ("nav", "div", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div"), "ad": ("div", "aside", "section"), "notice": ("div", "section"), "comments": ("section", "div", "div"), "form": ("form", "div"), "share": ("div", "section", "aside")}[kind]
        chosen = r.choice(tag)
        names = self.attributes(kind, 1.0 if chosen in ("div", "section") else 0.6)
        role = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "form"}.get(kind)
        if role and r.random() < 0.1:
            names += f' role="{role}"'

        def inside():
            if kind == "nav":
                self.links("nav", r.randint(2, 9))
            elif kind == "header":
                self.block(r.choice(("div", "p", "h2", "span", "h1")), self.sentence(r.randint(1, 9)), 0, "", 0.3)
                if r.random() < 0.4:
                    self.links("nav", r.randint(2, 6))
            elif kind == "footer":
                for _ in range(r.randint(1, 3)):
                    self.block(r.choice(("p", "div", "span")), r.choice(("© 2021 ", "© ", "")) + self.prose(r.randint(1, 25)), 0)
                if r.random() < 0.5:
                    self.links("footer", r.randint(1, 6))
            elif kind == "sidebar":
                for _ in range(r.randint(1, 3)):
                    self.block(r.choice(("h2", "h3", "h4", "p")), self.words(r.randint(1, 4)), 0)
                    if r.random() < 0.6:
                        self.links("share", r.randint(2, 6))
                    else:
                        self.block("p", self.prose(r.randint(5, 40)), 0)
            elif kind == "comments":
                self.block(r.choice(("h2", "h3", "h4")), self.words(r.randint(1, 3)), 0)
                for _ in range(r.randint(1, 4)):
                    one = r.choice(("div", "li", "article", "div"))

                    def reader():
                        self.block(r.choice(("span", "p", "b", "div")), self.words(r.randint(1, 3)), 0)
                        for _ in range(r.randint(1, 2)):
                            self.block(r.choice(("p", "p", "div")), self.prose(r.randint(3, 60)), 0)

                    self.wrapped(one, self.attributes("comments", 0.8), reader)
            elif kind == "form":
                self.block(r.choice(("p", "h3", "label", "div")), self.prose(r.randint(2, 15)), 0)
                for _ in range(r.randint(1, 3)):
                    self.block("label", self.words(r.randint(1, 3)), 0)
                    self.out.append("<input>")
            elif kind == "share":
                if r.random() < 0.6:
                    self.block(r.choice(("h3", "h4", "p")), self.words(r.randint(1, 4)), 0)
                self.links("share", r.randint(1, 6))
            else:
                for _ in range(r.randint(1, 3)):
                    self.block(r.choice(("p", "div", "span", "h4")), self.prose(r.randint(2, 35)), 0, "", 0.25)

        if r.random() < 0.15 and chosen in ("div", "section") and kind in ("ad", "notice", "footer"):
            self.block(chosen, self.prose(r.randint(2, 30)), 0, names)
        else:
            self.wrapped(chosen, names, inside)

    def article(self, inner: float) -> None:
        r = self.r
        if r.random() < 0.85:
            title = lambda: self.block(r.choice(("h1", "h1", "h1", "h2")), self.words(r.randint(1, 12)), 1)
            self.wrapped("header", self.attributes(None), title) if r.random() < 0.2 else title()
        for _ in range(r.choice((1, 2, 4, 7, 10))):
            x = r.random()
            if x < 0.62:
                self.block(r.choice(("p", "p", "p", "p", "p", "div")), self.prose(r.choice((1, 2, 4, 8, 15, 30, 60, 100))), 1)
            elif x < 0.72:
                self.block(r.choice(("h2", "h3", "h4")), self.words(r.randint(1, 7)), 1)
            elif x < 0.84:
                self.wrapped(r.choice(("ul", "ol")), "", lambda: [self.block("li", self.words(r.randint(1, 14)), 1, "", 0.1) for _ in range(r.randint(1, 6))])
            elif x < 0.9:
                self.wrapped("blockquote", "", lambda: self.block("p", self.prose(r.randint(3, 40)), 1))
            elif x < 0.95:
                self.wrapped("table", "", lambda: [self.wrapped("tr", "", lambda: [self.block("td", self.words(r.randint(1, 5)), 1) for _ in range(3)]) for _ in range(r.randint(1, 4))])
            else:
                self.wrapped("figure", "", lambda: self.block("figcaption", self.prose(r.randint(2, 14)), 1))
            if r.random() < inner:
                self.boilerplate(r.choice(("ad", "share", "form", "ad", "sidebar", "notice")))

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        bare = r.random() < 0.06  # nothing around the article
        before = [] if bare else [k for k in ("notice", "header", "nav", "ad", "share") if r.random() < 0.45]
        after = [] if bare else [k for k in ("share", "comments", "sidebar", "ad", "form", "footer", "notice") if r.random() < 0.4]
        layout = r.choice(("article", "article", "main", "main article", "div", "div", "section", "div div", "td", "none"))
        wholeform = r.random() < 0.06

        def content():
            tags = [] if layout == "none" else layout.split()

            def level(k: int):
                if k == len(tags):
                    self.article(0.0 if bare else r.choice((0, 0, 0.1, 0.2)))
                    return
                tag = tags[k]
                names = self.attributes("content", 0.95 if tag in ("div", "section", "td") else 0.5)
                self.wrapped(tag, names + (' role="main"' if r.random() < 0.04 else ""), lambda: level(k + 1))

            level(0)

        def body():
            for k in before:
                self.boilerplate(k)
            depth = r.choice((0, 0, 1, 2))
            self.out.append(f"<div{self.attributes(None)}>" * depth)
            content()
            for k in after[: len(after) // 2]:
                self.boilerplate(k)
            self.out.append("</div>" * depth)
            for k in after[len(after) // 2 :]:
                self.boilerplate(k)

        self.out.append("<html><head><title>t</title></head><body>")
        self.wrapped("form", "", body) if wholeform else body()
        self.out.append("</body></html>")
        return "".join(self.out), self.truth


def page(seed: int) -> tuple[str, list[tuple[str, int]]]:
    """(html, [(text of a block, 1 if it is content)]) in page order."""
    return _Maker(seed).page()
