"""Labelled pages to train the page model on: layouts with marked blocks, filled with invented words.

A layout is a sequence of parts (menu, header, article with parts between its paragraphs, comments,
side bar, footer, ...), each drawn from several ways in which sites write it.  The labels follow from
the part a block was written for.  Page ``i`` is the same wherever it is made.
"""

from __future__ import annotations

import html
import random

SYLLABLES = {
    "a": "the an er on in th re ou st ing tion ly ed nd ha es".split(),
    "b": "der sch ein ung keit heit lich ver ge en ü ä ß zu".split(),
    "c": "le que eau é è tion ment oi ai ou ç re un".split(),
    "d": "la ción mente ado os ar ez ñ ll rr í ue".split(),
    "e": "ка ни то ре ве ло ста ми по да".split(),
}


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = SYLLABLES[self.r.choice("aabbccdde")]
        self.marks: dict[str, bool] = {}

    # text

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        while True:
            text = " ".join(self.word() for _ in range(self.r.randint(a, b)))
            if text not in self.marks:
                return text

    def sentence(self, a: int = 3, b: int = 18) -> str:
        ws = self.words(a, b).split()
        return (" ".join(w + "," * (self.r.random() < 0.08) for w in ws[:-1]) + " " + ws[-1]).strip().capitalize() + "."

    def prose(self, a: int, b: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def mark(self, text: str, main: bool) -> str:
        """Registers a block's text; a text that stands for both labels is made unique."""
        text = " ".join(text.split())
        while self.marks.get(text, main) != main:
            text += " " + self.word()
        self.marks[text] = main
        return html.escape(text, quote=self.r.random() < 0.5)

    def main(self, text: str) -> str:
        return self.mark(text, True)

    def rest(self, text: str) -> str:
        return self.mark(text, False)

    # parts around the article

    def link(self, a: int = 1, b: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.rest(self.words(a, b).capitalize())}</a>'

    def links(self, a: int = 1, b: int = 3, n: tuple[int, int] = (2, 9)) -> str:
        return "<ul>" + "".join(f"<li>{self.link(a, b)}" + "</li>" * (self.r.random() < 0.9) for _ in range(self.r.randint(*n))) + "</ul>"

    def box(self, tags: list[str], names: list[str], inside: str) -> str:
        tag, name = self.r.choice(tags), self.r.choice(names)
        shown = self.r.choice([f' class="{name}"'] * 3 + [f' id="{name}"'] * 2 + [f' class="box {name} clearfix"', f' class="{name}-container"',
                                                                                 f' class="{name}-wrapper col"', f' id="{name}Box"'])
        if tag in ("nav", "header", "footer", "aside", "form") and self.r.random() < 0.5:
            shown = ""
        return f"<{tag}{shown}>{inside}</{tag}>"

    def some(self, a: int = 1, b: int = 2) -> str:
        """A line or two of text that is not the article's."""
        inside = self.rest(self.prose(a, b) if self.r.random() < 0.6 else self.words(1, 8))
        return self.r.choice([inside, f"<p>{inside}</p>", f"<span>{inside}</span>", f"<div>{inside}</div>"])

    def menu(self) -> str:
        return self.box(["nav", "nav", "div"], ["menu", "nav", "navbar", "main-nav", "navigation", "topnav", "breadcrumb", "breadcrumbs", "site-menu", "mainMenu"], self.links())

    def header(self) -> str:
        inside = self.r.choice([f"<h1>{self.rest(self.words(1, 4))}</h1>", f'<a href="/">{self.rest(self.words(1, 3))}</a>', f"<div>{self.rest(self.words(1, 3))}</div>"])
        if self.r.random() < 0.6:
            inside += self.r.choice([f"<p>{self.rest(self.sentence())}</p>", self.menu(), self.form()])
        return self.box(["header", "header", "div"], ["header", "site-header", "masthead", "top", "banner", "topbar", "page-header"], inside)

    def footer(self) -> str:
        sign = self.r.choice(["&copy; ", "© 2021 ", "Copyright ", ""])
        line = html.unescape(sign) + self.words(1, 4) + self.r.choice(["", " · " + self.prose(1, 2), " | " + self.words(1, 4), ". " + self.prose(1, 3)])
        inside = self.r.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<small>{}</small>"]).format(self.rest(line))
        if self.r.random() < 0.5:
            inside = self.links() + inside if self.r.random() < 0.5 else inside + self.links()
        return self.box(["footer", "footer", "footer", "div"], ["footer", "site-footer", "bottom", "copyright", "colophon", "foot", "page-footer"], inside)

    def aside(self) -> str:
        head = f"<h{(k := self.r.choice('234'))}>{self.rest(self.words(1, 4))}</h{k}>" if self.r.random() < 0.7 else ""
        inside = self.r.choice([self.links(2, 7), self.some(), f"<p>{self.rest(self.prose(1, 4))}</p>", self.links(1, 3) + self.some()])
        return self.box(["aside", "aside", "div", "section"], ["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "more-stories",
                                                              "promo", "newsletter", "author-box", "tags", "right-col", "sidebarRight", "read-more"], head + inside)

    def advert(self) -> str:
        return self.box(["div", "div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "banner-ad", "sponsor", "sponsored", "ad-slot", "adBox", "promoted"],
                        self.r.choice([self.some(), self.link(2, 9), self.rest(self.prose(1, 3))]))

    def notice(self) -> str:
        inside = self.some() + (f"<button>{self.rest(self.words(1, 2))}</button>" if self.r.random() < 0.7 else "")
        return self.box(["div", "div", "section", "aside", "dialog"], ["cookie", "cookies", "cookie-notice", "consent", "gdpr", "notice", "banner", "popup", "modal", "alert",
                                                             "cookieBar", "paywall", "subscribe", "privacy-notice"], inside)

    def form(self) -> str:
        fields = "".join(f"<label>{self.rest(self.words(1, 3))}</label><input name=x>" for _ in range(self.r.randint(0, 3)))
        fields += self.r.choice(["", f"<select><option>{self.rest(self.words(1, 2))}<option>{self.rest(self.words(1, 2))}</select>", f"<textarea>{self.rest(self.words(1, 4))}</textarea>",
                                 f"<p>{self.rest(self.sentence())}</p>"])
        return self.box(["form", "form", "form", "div"], ["search", "login", "signup", "search-form", "newsletter", "contact-form", "subscribe"],
                        fields + f"<button>{self.rest(self.words(1, 2))}</button>")

    def share(self) -> str:
        return self.box(["div", "div", "p"], ["share", "social", "social-links", "share-buttons", "tools", "meta", "tags", "byline-links"],
                        " ".join(self.link(1, 2) for _ in range(self.r.randint(2, 6))))

    def comments(self) -> str:
        one = ["div", "li", "article", "section"]
        items = "".join(self.box([self.r.choice(one)], ["comment", "reply", "comment-body", "response", "user-comment"],
                                 self.r.choice([f"<b>{self.rest(self.words(1, 2))}</b><p>{self.rest(self.prose(1, 4))}</p>",
                                                f"<p>{self.rest(self.prose(1, 5))}</p>", f"<div>{self.rest(self.words(1, 3))}</div><div>{self.rest(self.prose(1, 3))}</div>"]))
                        for _ in range(self.r.randint(1, 5)))
        head = f"<h3>{self.rest(self.words(1, 3))}</h3>" if self.r.random() < 0.6 else ""
        return self.box(["div", "div", "section", "aside"], ["comments", "comment-list", "discussion", "responses", "disqus", "comments-area", "reader-comments", "replies"],
                        head + items + (self.form() if self.r.random() < 0.4 else ""))

    # the article

    def paragraph(self) -> str:
        size = self.r.choice([(1, 1), (1, 2), (2, 5), (4, 12)])
        text = self.main(self.prose(*size) if self.r.random() < 0.93 else self.words(1, 6))
        words = text.split(" ")
        if self.r.random() < 0.3:
            k = self.r.randrange(len(words))
            tag = self.r.choice(["b", "i", "em", "strong", "span", 'a href="/x"', "mark", "code"])
            words[k] = f"<{tag}>{words[k]}" + (f"</{tag.split()[0]}>" if self.r.random() < 0.95 else "")
        return " ".join(words)

    def article(self) -> str:
        r = self.r
        style = r.choice(["p", "p", "p", "p open", "div", "mixed"])
        out = []
        if r.random() < 0.75:
            k = r.choice("11122")
            title = f"<h{k}>{self.main(self.words(2, 10).capitalize() + r.choice(['', '', '.']))}</h{k}>"
            out.append(title if r.random() < 0.85 else f"<header>{title}</header>")
        if r.random() < 0.2:
            out.append(self.share())
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            body = self.paragraph()
            kind = r.random()
            if style == "mixed" and kind < 0.4 or kind < 0.06:
                out.append(r.choice([f"<h{r.choice('234')}>{self.main(self.words(1, 7))}</h3>", f"<blockquote>{body}</blockquote>", f"<pre>{body}</pre>",
                                     f"<ul><li>{body}<li>{self.main(self.sentence())}</ul>", f"<figure><img src=x.png><figcaption>{self.main(self.sentence())}</figcaption></figure>",
                                     f"<table><tr><td>{self.main(self.words(1, 4))}</td><td>{body}</td></tr></table>"]))
            elif style == "p open":
                out.append(f"<p>{body}")
            elif style == "div":
                out.append(f"<div>{body}</div>")
            else:
                out.append(f"<p>{body}</p>")
            if r.random() < 0.08:
                out.append(r.choice([self.advert, self.advert, self.aside, self.share, self.form, self.notice])())
        inside = "\n".join(out) if r.random() < 0.5 else "".join(out)
        if r.random() < 0.15:
            inside += r.choice([self.comments, self.share, self.aside])()
        shell = r.choice(["article"] * 5 + ["main", "main", "div content", "div post-content", "div entry-content", "div article-body", "div story",
                          "section article", "div main", "div text", "div post", "div body", "td content", "div page", "div", "",
                          "div wrapper", "div col-main", "div main-column", "div main-content"])
        tag, _, name = shell.partition(" ")
        if not tag:
            return inside
        named = f' {r.choice(["class", "class", "id"])}="{name}"' if name else r.choice(["", "", ' class="post"', ' itemprop="articleBody"', ' class="story-body"']) if tag != "div" else ""
        body = f"<{tag}{named}>{inside}</{tag}>"
        if tag == "td":
            body = f"<table><tr>{body}</tr></table>"
        return f'<div class="{r.choice(["container", "wrapper", "page", "layout", "row", "site"])}">{body}</div>' if r.random() < 0.3 else body

    def page(self) -> str:
        r = self.r
        before = [f() for f in (self.header, self.menu, self.advert, self.notice, self.form, self.aside) if r.random() < 0.35]
        after = [f() for f in (self.share, self.comments, self.aside, self.advert, self.notice) if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        body = "".join([*before, r.choice(["", "<!-- x -->"]), self.article(), *after, self.footer() if r.random() < 0.85 else ""])
        end = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>x</title><script>var a='<p>';</script></head><body>{body}{end}"


def labelled_pages(n: int):
    """(html, {block text: whether it belongs to the article}) of page 0, 1, ..."""
    for i in range(n):
        p = _Page(i)
        page = p.page()
        yield page, _Marks(p.marks)


class _Marks(dict):
    """Labels by block text; a block that broken markup has joined from several takes the label of its longest part."""

    def __missing__(self, text: str) -> bool:
        inside = [(len(t), main) for t, main in self.items() if t in text]
        return max(inside)[1] if inside else False
