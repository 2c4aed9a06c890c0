"""The labelled table of the HTML extraction: pages whose main-text blocks begin with "+".

The pages are invented by rule from a seed: components (menus, notices, adverts, an article with
paragraphs, lists, tables and links, related links, comments, forms, sidebars, footers) in layouts
that tell what they are by their elements, by their names, by names that mislead, or not at all.
What a component is gives its blocks their label.
"""

from __future__ import annotations

import random

PAGES = 1500
_SYLLABLES = "ra li mo ten ver sa on il gar de pu ster no wa ke lan ti".split()
_NAMES = {
    "menu": ("menu", "nav", "top-nav", "navbar", "main-menu", "site-navigation"),
    "head": ("header", "masthead", "site-header", "banner"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promo-box"),
    "notice": ("notice", "cookie-notice", "alert", "consent", "popup"),
    "side": ("sidebar", "side-bar", "widgets", "widget", "related", "recommended"),
    "comments": ("comments", "comment-list", "replies", "disqus"),
    "form": ("newsletter", "signup", "subscribe", "search", "login-form"),
    "foot": ("footer", "site-footer", "copyright", "contentinfo"),
    "main": ("content", "post", "entry", "story", "article", "main-text", "post-body"),
}
_MISLEADING = ("content-form", "post-header", "story-share", "entry-widget", "article-banner", "text-search", "main-related", "body-alert")
_TAGS = {"menu": "nav", "head": "header", "side": "aside", "foot": "footer", "form": "form", "main": "article"}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.style = rng.choices(("elements", "names", "misled", "bare"), (5, 3, 3, 4))[0]

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randrange(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n)).capitalize()

    def sentences(self, n: int) -> str:
        out = []
        while n > 0:
            k = min(n, self.rng.randrange(1, 16))
            out.append(self.words(k) + ("." if self.rng.random() < 0.9 else self.rng.choice("!?")))
            n -= k
        return " ".join(out)

    def links(self, n: int, between: str = " ") -> str:
        return between.join(f"<a href=/{self.word()}>{self.words(self.rng.randrange(1, 5))}</a>" for _ in range(n))

    def some(self, p: float) -> bool:
        return self.rng.random() < p

    def box(self, kind: str, inner: str) -> str:
        """A component in its container, named as the page's style has it."""
        rng, tag = self.rng, "div"
        if self.style == "elements":
            tag = _TAGS.get(kind, "div")
            name = rng.choice(_NAMES[kind]) if tag == "div" or self.some(0.3) else ""
            if kind == "main" and self.some(0.3):
                tag = "main"
        elif self.style == "names":
            name = rng.choice(_NAMES[kind])
        elif self.style == "misled":
            name = rng.choice(_MISLEADING) if kind == "main" else rng.choice(_NAMES[kind]) if self.some(0.5) else self.word()
        else:
            name = self.word() if self.some(0.5) else ""
        attr = "" if not name else f' {rng.choice(("class", "id", "class"))}="{name}"'
        return f"<{tag}{attr}>{inner}</{tag}>" if not (tag == "div" and self.style == "bare" and self.some(0.4)) else inner

    def menu(self) -> str:
        n = self.rng.choice((1, 2, self.rng.randrange(2, 9)))
        if self.some(0.6):
            return "<ul>" + "".join(f"<li>{self.links(1)}</li>" for _ in range(n)) + "</ul>"
        return f"<{(p := self.rng.choice(('p', 'div')))}>{self.links(n, self.rng.choice((' ', ' | ')))}</{p}>"

    def paragraph(self) -> str:
        rng = self.rng
        n = rng.choice((rng.randrange(1, 5), rng.randrange(5, 30), rng.randrange(10, 40), rng.randrange(25, 130)))
        text = self.sentences(n)
        if self.some(0.2):
            text += " " + self.links(1) + "."
        if self.some(0.15):
            text = f"<b>{text}" + ("</b>" if self.some(0.7) else "")
        if self.some(0.12):
            text += f' <span class="{rng.choice(_NAMES["ad"])}">{self.words(rng.randrange(2, 9))}</span> {self.sentences(4)}'
        return f"<p>+{text}" + (rng.choice(("<br>", "<br><br>")) if self.some(0.1) else "") + ("</p>" if self.some(0.8) else "")

    def inside(self) -> str:
        """What stands between paragraphs without being main text."""
        rng, pick = self.rng, self.rng.randrange(5)
        if pick == 0:
            return self.named("ad", f"{self.sentences(rng.randrange(3, 25))}")
        if pick == 1:  # links to other pages, told by their density and that of their neighbours
            return "<ul>" + "".join(f"<li>{self.links(1)}</li>" for _ in range(rng.randrange(3, 7))) + "</ul>"
        if pick == 2:
            return f'<p class="{rng.choice(("ad", "footer-note", "promo", "share", "notice", "related"))}">{self.sentences(rng.randrange(2, 14))}</p>'
        if pick == 3:
            return self.named("notice", self.sentences(rng.randrange(4, 20)))
        return f'<p class=share>{self.links(rng.randrange(3, 6))}</p>'

    def named(self, kind: str, inner: str) -> str:
        return f'<div class="{self.rng.choice(_NAMES[kind])}">{inner}</div>'

    def article(self) -> str:
        rng = self.rng
        out = [f"<h1>+{self.words(rng.randrange(1, 10))}</h1>"] if self.some(0.9) else []
        if self.some(0.3) and self.style != "bare":
            out.insert(0, "<header>" if self.some(0.5) else '<div class="post-meta">')
            out.append(f"<p>+{self.words(rng.randrange(2, 6))}</p>" + ("</header>" if out[0] == "<header>" else "</div>"))
        # a page without any sign has more than one word to say
        least = 1 if self.style in ("elements", "names") else 3
        for k in range(rng.randrange(least, 9)):
            at = rng.random()
            if at < 0.7 or k == 0:
                out.append(self.paragraph() if self.style in ("elements", "names") or k else f"<p>+{self.sentences(rng.randrange(15, 60))}</p>")
            elif at < 0.76:
                out.append("<ul>" + "".join(f"<li>+{self.words(rng.randrange(1, 9))}</li>" for _ in range(rng.randrange(2, 5))) + "</ul>" + self.paragraph())
            elif at < 0.8:
                out.append("<table>" + "".join(f"<tr><td>+{self.word()}<td>+{rng.randrange(99)}" for _ in range(rng.randrange(2, 4))) + "</table>" + self.paragraph())
            elif at < 0.86:
                out.append(f"<h2>+{self.words(rng.randrange(1, 6))}</h2>" + self.paragraph())
            elif at < 0.9:
                out.append(f"<blockquote>+{self.sentences(rng.randrange(4, 30))}</blockquote>" + self.paragraph())
            elif at < 0.92:
                out.append(f"<p>+{self.links(1)}</p>" + self.paragraph())
            elif len(out) > 1:
                out.append(self.inside() + self.paragraph())
        return "".join(out)

    def comments(self) -> str:
        said = "".join(f"<div class=comment><p>{self.sentences(self.rng.randrange(1, 40))}</p></div>" for _ in range(self.rng.randrange(1, 4)))
        return f"<h2>{self.words(1)}</h2>{said}"

    def page(self) -> str:
        rng, bare = self.rng, self.style in ("bare", "misled")
        out = [self.box("menu", self.menu())]
        if self.some(0.4):
            out.insert(rng.randrange(2), self.box("head", f"<p>{self.words(rng.randrange(1, 6 if bare else 12))}</p>"))
        for kind, p in (("notice", 0.3), ("ad", 0.5)):
            if self.some(p):
                text = self.sentences(rng.randrange(2, 9 if bare else 30))
                out.append(self.named(kind, text) if self.some(0.8) else self.box(kind, f"<p>{text}</p>"))
        if rng.random() < 0.06:  # a page of links
            return "<body>" + "".join(out) + "".join(f"<p>{self.links(1)}</p>" for _ in range(rng.randrange(3, 9))) + f"<p>{self.words(3)}</p></body>"
        inner = self.article()
        if self.some(0.25):
            inner += self.named("comments", self.comments())
        out.append(self.box("main", inner))
        if self.some(0.4):
            out.append(self.box("side", f"<h3>{self.words(2)}</h3>{self.menu()}" + ("" if bare else f"<p>{self.sentences(rng.randrange(3, 40))}</p>")))
        if not bare and self.some(0.2):
            out.append(self.box("side", f"<article><h3>{self.words(4)}</h3><p>{self.sentences(rng.randrange(4, 30))}</p></article>") if self.style == "elements" else "")
        if self.some(0.25):
            out.append(self.box("form", f"<p>{self.words(rng.randrange(2, 7 if bare else 12))}</p><label>{self.word()}</label><button>{self.word()}</button>"))
        if self.some(0.2) and not bare:
            out.append(self.box("comments", self.comments()))
        if self.some(0.25):
            out.append(f"<p>{self.links(rng.randrange(2, 6), rng.choice((' ', ' | ')))}</p>")
        if self.some(0.6):
            out.append(self.box("foot", f"<p>&copy; {self.words(rng.randrange(1, 6 if bare else 25))}{'.' if self.some(0.5) else ''}" + (self.links(2) if self.some(0.3) else "") + "</p>"))
        if self.style == "elements" and self.some(0.3):  # little text is an article too
            say = self.words if self.some(0.2) else self.sentences
            short = [f"<p>+{say(rng.choice((rng.randrange(1, 4), rng.randrange(3, 12))))}</p>" for _ in range(rng.randrange(1, 5))]
            if len(short) > 1 and self.some(0.5):
                short.insert(rng.randrange(1, len(short) + 1), self.inside())
            head = f"<h1>+{self.words(rng.randrange(1, 7))}</h1>" if self.some(0.7) else ""
            tail = self.box("foot", f"&copy; {self.sentences(rng.randrange(1, 25))}")
            menu, ad = self.box("menu", self.menu()), self.named("ad", self.sentences(rng.randrange(1, 20)))
            side = f"<aside>{self.sentences(rng.randrange(1, 20))}</aside>" if self.some(0.3) else ""
            before, after = ("", menu + side) if self.some(0.2) else (menu + side, "")
            out = [before, ad if self.some(0.6) else "", f"<article>{after}{head}{''.join(short)}</article>", tail if self.some(0.7) else ""]
        elif self.some(0.15):  # nothing else on the page
            out = [self.box("main", "".join(f"<p>+{self.sentences(rng.randrange(1, 50))}</p>" for _ in range(rng.randrange(2, 6))) if self.some(0.5) else self.article())]
            if self.style == "elements" and self.some(0.4):
                out = [f"<article><p>+{self.words(rng.randrange(1, 9))}</p></article>"]
        body = "".join(out)
        if self.some(0.12):
            body = f'<form id="page">{body}</form>'
        elif self.some(0.12):
            body = f'<div class="{rng.choice(("page with-sidebar", "layout nav-open", "wrap", "site-search-on"))}">{body}</div>'
        return f"<html><head><title>{self.words(3)}</title></head><body{rng.choice(('', ' class=nav-open', ' class=home'))}>{body}</body></html>"


def pages(seed: int = 3, n: int = PAGES) -> list[str]:
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(n)]
