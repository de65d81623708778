"""Labelled pages for training: layouts of many kinds, filled with made-up words."""

from __future__ import annotations

import html
import random

_SOUNDS = "ba ce di fo gu la me ni so tu ra ve ri po lu an er in or un st ch th el as to re mi no ka".split()
_SMALL = "the of and to a in is it on as with for la de le der die und que el los un y".split()
_MENU = "Home About Contact News Sports Shop Login Search Products Services Help FAQ Archive Topics Start Inicio Accueil".split()
_FOOT = (
    "© 2021 {}. All rights reserved.", "© {}", "Copyright {} Privacy Terms Imprint", "Terms of service | Privacy policy", "Follow us on {}",
    "Powered by {}", "© {} · {}",
)
_NOTICE = ("We use cookies to improve this site.", "Accept all cookies", "Subscribe to our newsletter today!", "Please enable scripts to read {}.")
_ADVERT = ("Buy {} now and save!", "Sponsored: {}", "Advertisement", "{}", "Best {} deals")
_FORM = ("Your name", "E-mail", "Send", "Search", "Sign up", "Password", "Leave a reply")


class _Writer:
    """Writes a page and remembers the label of every block: 1 article, 0 the rest."""

    def __init__(self, seed: str) -> None:
        self.rng = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[tuple[str, int]] = []
        kind = self.rng.random()
        self.plain = kind < 0.15  # no telling tags, so names tell
        self.unnamed = kind > 0.88  # no telling names, so tags tell
        self.odd = self.rng.choice(("", "", "", "", "loud", "marked", "listed", "numbers", "bare"))  # how sentences look

    def word(self) -> str:
        r = self.rng
        return r.choice(_SMALL) if r.random() < 0.35 else "".join(r.choice(_SOUNDS) for _ in range(r.randint(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentences(self, n: int) -> str:
        out = []
        for _ in range(n):
            s = [self.word() for _ in range(self.rng.choice((1, 3, 6, 9, 14, 20)))]
            if len(s) > 5 and self.odd != "bare":
                s[len(s) // 2] += ","
            text = " ".join(s).capitalize() + self.rng.choice((".", ".", ".", ".", ".", "!", "?", ":", ""))
            if self.odd == "loud":
                text = " ".join(f"{w}{self.rng.choice(('!!', '!', ''))}" for w in text.upper().split())
            elif self.odd == "marked":
                text = " ".join(w + self.rng.choice(("***", "###", "$$$", "&&&", "%%%")) for w in text.split())
            elif self.odd == "listed":
                text = " | ".join(text.split())
            elif self.odd == "numbers":
                text = " ".join(self.rng.choice((w, str(self.rng.randint(1, 99999)), f"{w}@example.com")) for w in text.split())
            out.append(text)
        return " ".join(out)

    def open(self, tag: str, *names: str) -> str:
        """Opens an element, by its own tag or as a div; returns the tag to close it with."""
        name = self.rng.choice(names) if names and not self.unnamed and (self.plain or self.rng.random() < 0.6 or tag in ("div", "ins", "section")) else ""
        tag = "div" if self.plain else tag
        key = self.rng.choice(("class", "class", "id"))
        self.html.append(f'<{tag} {key}="{name}">' if name else f"<{tag}>")
        return tag

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>")

    def block(self, tag: str, text: str, label: int, inner: str = "{}", names: str = "") -> None:
        text = " ".join(text.split())
        mark = f' class="{names}"' if names and not self.unnamed else ""
        self.html.append(f"<{tag}{mark}>{inner.format(html.escape(text, quote=False))}" + ("" if tag == "p" and self.rng.random() < 0.1 else f"</{tag}>"))
        self.labels.append((text, label))

    def fill(self, choices) -> str:
        return self.rng.choice(choices).replace("{}", self.words(self.rng.randint(1, 3)))

    def prose(self) -> str:
        """Boilerplate is often written like the article."""
        return self.sentences(self.rng.randint(1, 2)) if self.rng.random() < 0.6 else self.words(self.rng.randint(1, 8))

    def menu(self) -> None:
        r = self.rng
        tag = self.open("nav", "menu", "nav", "navigation", "topnav", "breadcrumb", "navbar")
        listed = r.random() < 0.7
        if listed:
            self.html.append("<ul>")
        for _ in range(r.randint(2, 8)):
            text = r.choice(_MENU) if r.random() < 0.5 else self.words(r.randint(1, 2))
            self.block("li" if listed else "div", text, 0, '<a href="/x">{}</a>')
        if listed:
            self.html.append("</ul>")
        self.close(tag)

    def side(self, kind: str) -> None:
        r = self.rng
        if kind == "advert":
            tag = self.open("aside" if self.unnamed else r.choice(("div", "div", "aside", "section", "ins")), "ad", "ads", "advert", "sponsored", "banner ad", "promo", "adbox", "ad slot")
            for _ in range(r.randint(1, 2)):
                self.block(r.choice(("p", "div")), self.fill(_ADVERT) if r.random() < 0.4 else self.prose(), 0, r.choice(("{}", '<a href="/b">{}</a>')))
            self.close(tag)
        elif kind == "notice":
            tag = self.open(r.choice(("aside", "dialog") if self.unnamed else ("div", "section", "aside", "dialog")), "cookie notice", "notice", "consent", "newsletter", "alert", "banner", "popup", "subscribe")
            self.block(r.choice(("p", "div")), self.fill(_NOTICE) if r.random() < 0.6 else self.prose(), 0)
            if r.random() < 0.5:
                self.block("button", "Accept", 0)
            self.close(tag)
        elif kind == "form":
            tag = self.open("form", "form", "search form", "login", "contact form")
            for _ in range(r.randint(1, 4)):
                self.block(r.choice(("label", "button", "p")), r.choice(_FORM) if r.random() < 0.7 else self.prose(), 0)
            self.close(tag)
        elif kind == "comments" and not self.unnamed:
            tag = self.open("div" if r.random() < 0.6 else "section", "comments", "comment list", "discussion", "responses", "user comments", "replies")
            if r.random() < 0.7:
                self.block(r.choice(("h2", "h3")), r.choice(("Comments", "Responses", "Discussion", self.words(2))), 0)
            for _ in range(r.randint(1, 5)):
                own = self.open(r.choice(("div", "div", "article")), "comment", "reply", "response", "comment body")
                if r.random() < 0.5:
                    self.block("div", self.words(2) + " wrote:", 0, names="author")
                self.block("p", self.prose(), 0)
                self.close(own)
            self.close(tag)
        else:
            tag = self.open("aside", "sidebar", "side", "related", "widget", "rail", "recommended", "secondary")
            if r.random() < 0.6:
                self.block(r.choice(("h2", "h3", "h4")), r.choice(("Related", "Most read", self.words(2))), 0)
            for _ in range(r.randint(1, 5)):
                self.block(r.choice(("li", "p", "div")), self.prose(), 0, r.choice(("{}", '<a href="/r">{}</a>')))
            self.close(tag)

    def article(self) -> None:
        r = self.rng
        outer = self.open("main", "main", "content", "page") if r.random() < 0.4 else None
        tag = self.open(r.choice(("article", "article", "article", "section", "div")), "article", "post", "content", "entry content", "article body", "story", "text")
        head = self.open("header", "article header", "entry header", "title") if r.random() < 0.2 else None
        if r.random() < 0.9:
            self.block("h1", self.sentences(1) if r.random() < 0.5 else self.words(r.randint(2, 9)), 1)
        if head:
            if r.random() < 0.5:
                self.block("p", self.sentences(1), 1)
            self.close(head)
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            x = r.random()
            if x < 0.62:
                self.block("div" if r.random() < 0.12 else "p", self.sentences(r.randint(1, 5)), 1, r.choice(("{}", "{}", "<b>{}<br>", "{} <br>", "<em>{}</em>", '<a href="/i">{}</a>')))
            elif x < 0.70:
                self.block(r.choice(("h2", "h3")), self.words(r.randint(1, 6)), 1)
            elif x < 0.78:
                kind = r.choice(("ul", "ol"))
                self.html.append(f"<{kind}>")
                for _ in range(r.randint(1, 4)):
                    self.block("li", self.words(r.randint(1, 12)), 1)
                self.html.append(f"</{kind}>")
            elif x < 0.84:
                self.block(r.choice(("blockquote", "pre")), self.sentences(r.randint(1, 2)), 1)
            elif x < 0.88:
                self.html.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.block("td", self.words(r.randint(1, 3)), 1)
                self.html.append("</tr></table>")
            elif x < 0.91:
                self.html.append("<figure>")
                self.block("figcaption", self.words(r.randint(2, 8)), 1)
                self.html.append("</figure>")
            elif x < 0.95 and not self.unnamed:
                self.side(r.choice(("advert", "form", "notice", "related")))
            else:
                self.block("p", self.words(r.randint(1, 3)), 1)
        if r.random() < 0.2 and not self.unnamed:
            self.side("comments")
        self.close(tag)
        if outer:
            self.close(outer)

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.08:  # nothing but the article
            if r.random() < 0.3:
                text = self.sentences(r.randint(1, 8))
                self.html.append(html.escape(text, quote=False))
                self.labels.append((text, 1))
            else:
                self.html.append("<html><body>")
                for _ in range(r.randint(1, 6)):
                    self.block(r.choice(("p", "p", "p", "h1", "h2", "div")), self.sentences(r.randint(1, 4)), 1)
            return "".join(self.html)
        self.html.append("<!DOCTYPE html><html><head><title>" + self.words(4) + "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
        if r.random() < 0.35:
            tag = self.open("header", "header", "masthead", "site header", "top")
            self.block(r.choice(("div", "h1", "p")), self.words(r.randint(1, 4)), 0, names="logo")
            if r.random() < 0.6:
                self.menu()
            self.close(tag)
        if r.random() < 0.8:
            self.menu()
        for kind in ("notice", "advert", "form"):
            if r.random() < 0.3:
                self.html.append("<!-- x -->")
                self.side(kind)
        if r.random() < 0.15:
            self.side("related")
        self.article()
        if r.random() < 0.1:  # the page was cut
            return "".join(self.html)
        after = ["comments", "related", "advert", "form", "notice"]
        r.shuffle(after)
        for kind in after:
            if r.random() < 0.25:
                self.side(kind)
        if r.random() < 0.85:
            tag = self.open("footer", "footer", "site footer", "bottom", "legal")
            for _ in range(r.randint(1, 3)):
                text = self.fill(_FOOT)
                self.block(r.choice(("p", "div")), text if r.random() < 0.6 else f"{text} {self.prose()}", 0)
            self.close(tag)
        self.html.append("</body></html>")
        return "".join(self.html)


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[tuple[str, int]]]]:
    """``n`` pages with the text and label of each of their blocks, in page order."""
    out = []
    for i in range(n):
        w = _Writer(f"{seed}-{i}")
        out.append((w.page(), w.labels))
    return out
