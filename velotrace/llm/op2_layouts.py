"""Made-up pages whose blocks are labelled: what the block classifier of op2_html is fitted on. Nothing here comes from the tables that are read."""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ten ra su vo pel dra nim os tul er in gha".split()
_PLAIN = ("c1", "wrap", "row", "layout", "inner", "box", "col-8", "grid", "x-panel", "page with-sidebar", "post has-comments", "layout sidebar-right", "no-js site", "")
_BODY = ("post-content", "entry", "article-body", "story", "main-text", "content", "c9", "col-8", "x-panel", "")
_ADS, _NOTICE, _SIDE, _COMMENTS, _RELATED = ("ad", "advert", "sponsor-box", "promo"), ("cookie-notice", "consent", "newsletter", "popup"), ("sidebar", "widget", "side-col", "col-4", "c3"), ("comments", "comment-list", "discussion", "replies"), ("related", "recommended", "c5", "related-posts")


class _Page:
    def __init__(self, seed: int):
        self.rng, self.content, self.seed, self.n = random.Random(seed), set(), seed, 0

    def words(self, n: int) -> str:
        self.n += 1  # a word of its own: texts of one page differ
        out = ["".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4))) for _ in range(max(n - 1, 0))] + [f"z{self.n}"]
        self.rng.shuffle(out)
        return " ".join(out)

    def sentences(self, n: int) -> str:
        out = []
        while n > 0:
            k = min(n, self.rng.randint(4, 18))
            out.append(self.words(k).capitalize() + self.rng.choice(".....?!"))
            n -= k
        return " ".join(out)

    def tag(self, name: str, inner: str, cls: str = "") -> str:
        return f'<{name} {self.rng.choice(("class", "id"))}="{cls}">{inner}</{name}>' if cls else f"<{name}>{inner}</{name}>"

    def keep(self, text: str) -> str:
        self.content.add(text)
        return text

    def links(self, n: int, li: bool) -> str:
        made = [f'<a href="/{k}">{self.words(self.rng.randint(1, 6))}</a>' for k in range(n)]
        return self.tag("ul", "".join(f"<li>{x}</li>" for x in made)) if li else "".join(f"<div>{x}</div>" for x in made)

    def noise(self) -> str:
        """What stands inside or next to an article and isn't part of it."""
        r = self.rng
        k = r.randrange(6)
        if k == 0:
            return self.tag("div", self.sentences(r.randint(3, 25)), r.choice(_ADS))
        if k == 1:
            return self.tag("div", self.links(r.randint(2, 4), r.random() < 0.5), r.choice(("share", "social", "tags", "c4")))
        if k == 2:
            return self.tag("aside", self.tag("p", self.sentences(r.randint(5, 40))))
        if k == 3:
            return self.tag("p", self.sentences(r.randint(4, 20)), r.choice(_NOTICE))
        if k == 4:
            return f"<form>{self.words(4)}<input></form>"
        return self.tag("div", self.links(r.randint(2, 5), True), r.choice(_RELATED))

    def article(self) -> str:
        r, out = self.rng, []
        out.append(f"<h1>{self.keep(self.words(r.randint(2, 12)))}</h1>")
        if r.random() < 0.3:
            out[0] = f"<header>{out[0]}</header>"
        for _ in range(r.randint(1, 9)):
            k = r.random()
            if k < 0.6:
                out.append(f"<p>{self.keep(self.sentences(r.randint(1, 90)))}</p>")
            elif k < 0.7:
                out.append(f"<p>{self.keep(self.words(r.randint(1, 5)))}</p>")
            elif k < 0.78:
                out.append(f"<h2>{self.keep(self.words(r.randint(1, 6)))}</h2><p>{self.keep(self.sentences(r.randint(8, 50)))}</p>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.keep(self.words(r.randint(1, 12)))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif k < 0.93:
                out.append(f"<blockquote>{self.keep(self.sentences(r.randint(5, 40)))}</blockquote>")
            elif k < 0.96:
                a, b, c = self.words(3), self.words(2), self.words(4)
                self.content.add(f"{a} {b} {c}")
                out.append(f'<p>{a} <a href="/x">{b}</a> {c}</p>')
            else:
                out.append(self.noise())
        return "".join(out)

    def around(self) -> str:
        r = self.rng
        k = r.randrange(7)
        if k == 0:
            return self.tag("div", self.links(r.randint(3, 8), r.random() < 0.6), r.choice(("menu", "topnav", "c2")))
        if k == 1:
            return self.tag("div", self.tag("p", self.sentences(r.randint(4, 30))), r.choice(_NOTICE))
        if k == 2:
            return self.tag("div", self.sentences(r.randint(2, 25)), r.choice(_ADS))
        if k == 3:
            inner = "".join(f"<h3>{self.words(2)}</h3>{self.links(r.randint(2, 5), True)}" + (f"<p>{self.sentences(r.randint(3, 20))}</p>" if r.random() < 0.5 else "") for _ in range(r.randint(1, 3)))
            return self.tag(r.choice(("div", "aside", "section")), inner, r.choice(_SIDE))
        if k == 4:
            one = lambda: self.tag(r.choice(("article", "div", "li")), f"<b>{self.words(1)}</b><p>{self.sentences(r.randint(2, 50))}</p>", r.choice(("comment", "reply", "c8", "comment-body")))
            return self.tag(r.choice(("section", "div")), "".join(one() for _ in range(r.randint(1, 5))), r.choice(_COMMENTS))
        if k == 5:
            one = lambda: self.tag(r.choice(("article", "div")), f'<h3><a href="/r">{self.words(r.randint(3, 9))}</a></h3>', "teaser")
            return self.tag("div", "".join(one() for _ in range(r.randint(2, 4))), r.choice(_RELATED))
        return self.tag("div", self.words(r.randint(1, 6)), r.choice(("breadcrumb", "c6", "toolbar")))

    def html(self) -> str:
        r = self.rng
        body = self.article()
        kind = r.random()
        body = f"<article>{body}</article>" if kind < 0.4 else f"<main>{body}</main>" if kind < 0.55 else self.tag("div", body, r.choice(_BODY))
        before, after = ("".join(self.around() for _ in range(r.randrange(4))) for _ in range(2))
        body = before + body + after
        for _ in range(r.randrange(3)):
            body = self.tag("div", body, r.choice(_PLAIN))
        top = self.tag("header", self.words(r.randint(1, 4)) + (self.tag("nav", self.links(4, True)) if r.random() < 0.6 else "")) if r.random() < 0.6 else ""
        end = self.tag("footer", f"&copy; {self.words(2)} {self.sentences(r.randint(1, 20))}") if r.random() < 0.8 else ""
        return f"<html><head><title>{self.words(3)}</title></head><body>{top}{body}{end}</body></html>"


def page(seed: int) -> tuple[str, set[str]]:
    """(html, the texts of its content blocks)."""
    p = _Page(seed)
    return p.html(), p.content
