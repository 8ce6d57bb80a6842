"""Labelled training pages for the extraction model, composed from parts.

Every part is marked with ``data-main`` 1 (article) or 0 (anything else); marks are inherited by
what is inside. Words are drawn by a fixed generator, so only structure and size can be learned.
"""

from __future__ import annotations

import random

#: Names that pages give to their parts.
MAIN_NAMES = ("article", "post", "entry-content", "story-body", "content", "main-text", "blog-post")
SIDE_NAMES = ("sidebar", "widget", "related-posts", "right-rail", "promo", "newsletter", "social-share")
NOTICE_NAMES = ("cookie-notice", "banner", "notice", "popup", "consent", "alert")
MENU_NAMES = ("menu", "navbar", "breadcrumb", "main-nav", "pagination", "toc-menu")
COMMENT_NAMES = ("comments", "comment-list", "discussion", "replies", "respond")
FOOT_NAMES = ("footer", "site-footer", "legal", "copyright")
HEAD_NAMES = ("header", "site-header", "masthead", "topbar", "logo")
AD_NAMES = ("ad", "advert", "sponsored", "ads-box", "advertisement")


class _Maker:
    def __init__(self, seed: int):
        self.draw = random.Random(seed)
        self.more = random.Random(seed + 1_000_000)  # for parts that some articles have besides

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.draw.choices("aeinorst", k=self.draw.randint(2, 8))) for _ in range(self.draw.randint(low, high)))

    def one(self, names):
        return self.draw.choice(names)

    def named(self, tag: str, names) -> str:
        return f'{tag} {self.draw.choice(("class", "id"))}="{self.one(names)}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(n))

    def paragraph(self) -> str:
        text = self.words(1, 120) if self.draw.random() < 0.85 else self.words(1, 4)
        if self.draw.random() < 0.2:
            text += f' <a href="/y">{self.words(1, 4)}</a> {self.words(2, 30)}'
        return f"<p>{text}.</p>"

    def article(self) -> str:
        d = self.draw
        title = f"<h1>{self.words(2, 14)}</h1>"
        body = [self.paragraph() for _ in range(d.randint(1, 9))]
        if d.random() < 0.3:
            body.insert(d.randint(0, len(body)), f"<h2>{self.words(1, 6)}</h2>")
        if d.random() < 0.25:
            body.append("<ul>" + "".join(f"<li>{self.words(3, 20)}</li>" for _ in range(3)) + "</ul>")
        if d.random() < 0.2:
            body.append(f"<blockquote><p>{self.words(5, 40)}</p></blockquote>")
        if d.random() < 0.15:
            body.append(f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>")
        if d.random() < 0.15:
            body.append(f"<pre>{self.words(4, 20)}</pre>")
        for part in (self.figure, self.details):
            if self.more.random() < 0.3:
                body.insert(self.more.randint(0, len(body)), part())
        if d.random() < 0.25:  # parts that stand inside the article without belonging to it
            inner = d.choice((self.ad, self.share, self.side))()
            body.insert(d.randint(0, len(body)), inner)
        if d.random() < 0.15:
            body.append(self.comments())
        inside = title + "".join(body)
        wrap = d.choice(("article", "article", "article", "main", self.named("div", MAIN_NAMES), self.named("section", MAIN_NAMES), self.named("div", MAIN_NAMES)))
        tag = wrap.split()[0]
        inside = f"<{wrap} data-main=1>{inside}</{tag}>"
        return f"<main data-main=1>{inside}</main>" if tag != "main" and d.random() < 0.25 else inside

    def figure(self) -> str:
        said = "".join(self.more.choices("aeinorst ", k=self.more.randint(6, 120)))
        inside = self.more.choice((f"<img><figcaption>{said}</figcaption>", f"<picture><img></picture><figcaption><p>{said}</p></figcaption>", f"<figcaption>{said}</figcaption><img>"))
        return f"<figure>{inside}</figure>"

    def details(self) -> str:
        sizes = [self.more.randint(4, 24) if self.more.random() < 0.4 else self.more.randint(24, 400) for _ in range(self.more.randint(1, 4))]
        texts = ["".join(self.more.choices("aeinorst ", k=k)) for k in sizes]
        inside = "".join(f"<p>{t}</p>" for t in texts) if self.more.random() < 0.7 else texts[0]
        return f"<details><summary>{texts[0][:20]}</summary>{inside}</details>"

    def menu(self) -> str:
        wrap = self.draw.choice(("nav", self.named("div", MENU_NAMES), self.named("ul", MENU_NAMES)))
        inside = self.links(self.draw.randint(3, 12))
        return f"<{wrap} data-main=0>{inside if wrap.startswith('ul') else f'<ul>{inside}</ul>'}</{wrap.split()[0]}>"

    def head(self) -> str:
        wrap = self.draw.choice(("header", self.named("div", HEAD_NAMES)))
        return f'<{wrap} data-main=0><a href="/">{self.words(1, 3)}</a><p>{self.words(2, 8)}</p>{self.menu() if self.draw.random() < 0.5 else ""}</{wrap.split()[0]}>'

    def foot(self) -> str:
        wrap = self.draw.choice(("footer", "footer", self.named("div", FOOT_NAMES)))
        text = self.words(2, 40)
        inside = self.draw.choice((f"&copy; {text}", f"<p>{text}</p>", f"<p>{text}</p><ul>{self.links(3)}</ul>"))
        return f"<{wrap} data-main=0>{inside}</{wrap.split()[0]}>"

    def side(self) -> str:
        wrap = self.draw.choice(("aside", self.named("aside", SIDE_NAMES), self.named("div", SIDE_NAMES)))
        inside = self.draw.choice((f"<h3>{self.words(1, 4)}</h3><ul>{self.links(4)}</ul>", f"<p>{self.words(3, 60)}</p>", self.words(3, 60)))
        return f"<{wrap} data-main=0>{inside}</{wrap.split()[0]}>"

    def ad(self) -> str:
        text = self.words(1, 40)
        return f'<{self.named("div", AD_NAMES)} data-main=0>{text if self.draw.random() < 0.7 else f"<p>{text}</p>"}</div>'

    def share(self) -> str:
        return f'<div class="social-share" data-main=0><a href="/s">{self.words(1, 2)}</a> <a href="/t">{self.words(1, 2)}</a></div>'

    def notice(self) -> str:
        return f'<{self.named("div", NOTICE_NAMES)} data-main=0><p>{self.words(5, 40)}</p><button>{self.words(1, 2)}</button></div>'

    def form(self) -> str:
        return f'<form data-main=0><label>{self.words(1, 4)}</label><input><textarea></textarea><p>{self.words(2, 12)}</p><button>{self.words(1, 2)}</button></form>'

    def comments(self) -> str:
        wrap = self.named(self.draw.choice(("div", "section", "ul")), COMMENT_NAMES)
        tag = wrap.split()[0]
        inner = "li" if tag == "ul" else "div"
        said = "".join(f'<{inner} class="comment"><b>{self.words(1, 2)}</b><p>{self.words(3, 70)}</p></{inner}>' for _ in range(self.draw.randint(1, 5)))
        return f"<{wrap} data-main=0>{said}</{tag}>"

    def page(self) -> str:
        d = self.draw
        before = [p() for p in (self.head, self.menu, self.notice, self.ad, self.side) if d.random() < 0.5]
        after = [p() for p in (self.side, self.comments, self.form, self.ad, self.notice) if d.random() < 0.4]
        d.shuffle(before)
        middle = "".join(before) + self.article() + "".join(after)
        if d.random() < 0.4:
            middle = f'<div class="{d.choice(("wrapper", "container", "page", "row"))}" data-main=0>{middle}</div>'
        return f"<html><body data-main=0>{middle}{self.foot() if d.random() < 0.8 else ''}</body></html>"


def labelled_pages(n: int = 400) -> list[str]:
    """Training pages, the same on every call."""
    return [_Maker(k).page() for k in range(n)]
