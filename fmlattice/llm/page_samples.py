"""Labelled pages for the block chain: pages in many layouts, drawn from a seed, of
which it is known what the main text is.  They vary as sites do: semantic tags or
nested divs with telling class names, menus, banners, notices, adverts, side
columns, forms, comments and footers, with broken or missing end tags."""

from __future__ import annotations

import random

from html import escape

N_PAGES = 320
SYLLABLES = "an be co da el fi go hu in ja ka lo mi no or pa qui re sa to un ve wa zu é ü ción tion ing".split()

MAIN_WRAPS = [("article", ""), ("main", ""), ("article", ' class="post"'), ("div", ' class="article-body"'),
              ("div", ' id="content"'), ("div", ' class="post-content entry"'), ("section", ' class="story"'),
              ("div", ' class="main-content"'), ("div", ' class="text body"'), ("div", ' id="main"'),
              ("div", ' class="entry-content"'), ("div", ' class="blog prose"'), ("div", ' role="main"'), ("div", ' itemprop="articleBody"')]
MENU_WRAPS = [("nav", ""), ("div", ' class="nav"'), ("ul", ' class="menu"'), ("div", ' id="navigation"'),
              ("nav", ' class="breadcrumb"'), ("div", ' class="navbar top"'), ("nav", ' class="pagination"'), ("div", ' class="menu main-menu"'), ("div", ' role="navigation"'),
              ("select", ""), ("ul", ' class="tabs links"'), ("div", ' class="toc breadcrumbs"')]
HEAD_WRAPS = [("header", ""), ("div", ' class="header"'), ("div", ' id="masthead"'), ("header", ' class="site-header"'), ("div", ' class="top banner logo"'), ("div", ' role="banner"')]
SIDE_WRAPS = [("aside", ""), ("div", ' class="sidebar"'), ("div", ' class="related"'), ("aside", ' class="widget"'),
              ("div", ' id="sidebar"'), ("div", ' class="recommended teaser"'), ("div", ' class="share social"'), ("div", ' class="side rail"'), ("div", ' class="widget tags"'),
              ("div", ' role="complementary"'), ("section", ' class="related-posts more"')]
AD_WRAPS = [("div", ' class="ad"'), ("div", ' class="ads"'), ("div", ' id="advert"'), ("aside", ' class="sponsored"'),
            ("div", ' class="advertisement"'), ("div", ' class="promo banner"'), ("div", ' class="ad-slot adv"'), ("div", ' class="sponsor outbrain"'), ("section", ' class="advert commercial"'),
            ("div", ' id="banner-ad"'), ("template", "")]
NOTE_WRAPS = [("div", ' class="cookie"'), ("div", ' class="notice"'), ("div", ' id="cookie-banner"'),
              ("section", ' class="consent"'), ("div", ' role="alert"'), ("div", ' class="popup modal"'),
              ("dialog", ' class="newsletter"'), ("div", ' class="gdpr privacy"'), ("div", ' class="alert warning"'),
              ("div", ' class="subscribe signup"'), ("p", ' class="disclaimer"'), ("div", ' class="paywall notification"'),
              ("noscript", "")]
COMMENT_WRAPS = [("section", ' class="comments"'), ("div", ' id="comments"'), ("div", ' class="comment-list"'),
                 ("ol", ' class="comment"'), ("div", ' class="replies disqus"'), ("div", ' id="respond"'), ("ul", ' class="comments discussion"'),
                 ("div", ' class="reader-comments feedback"')]
FOOT_WRAPS = [("footer", ""), ("div", ' class="footer"'), ("div", ' id="footer"'), ("footer", ' class="site-footer"'),
              ("div", ' class="copyright"'), ("div", ' class="bottom legal"'), ("div", ' role="contentinfo"')]


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.n = 0

    def words(self, n: int) -> str:
        out = []
        for i in range(n):
            w = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))
            out.append(w.capitalize() if i == 0 else w)
        self.n += 1
        return " ".join(out) + f" {self.n}x" * (n > 1)         # no two stretches are equal

    def sentences(self) -> str:
        style = self.r.random()
        mark = self.r.choice(["", "", "", "***", "###", "&", "%%%"])
        return " ".join(self.words(self.r.randint(1 if style < 0.2 else 3, 5 if style < 0.2 else 30)) + mark +
                        self.r.choice([".", ".", ".", "!", ","]) for _ in range(self.r.randint(1, 1 if style < 0.3 else 6)))

    def wrap(self, wraps, inner: str) -> str:
        tag, attrs = self.r.choice(wraps)
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self) -> str:
        items = [f'<li><a href="/{i}">{escape(self.words(self.r.randint(1, 3)))}</a></li>'
                 for i in range(self.r.randint(2, 7))]
        return self.r.choice(["<ul>{}</ul>", "{}"]).format("".join(items))

    def article(self, main: set[str]) -> str:
        out = []

        def say(text: str) -> str:
            main.add(" ".join(text.split()))
            return escape(text, quote=False)

        if self.r.random() < 0.8:
            out.append(f"<h1>{say(self.words(self.r.randint(2, 12)) + self.r.choice(['', '.']))}</h1>")
        for k in range(self.r.choice([1, 2, 4, 8, 12])):
            kind = self.r.random()
            if kind < 0.70 and self.r.random() < (0.15 if k == 0 else 0.04):      # a paragraph that is a link
                out.append(f'<p><a href="/{self.n}">{say(self.sentences())}</a></p>')
            elif kind < 0.70:
                out.append(f"<p>{say(self.sentences())}</p>")
            elif kind < 0.78:
                out.append(f"<p><b>{say(self.sentences())}<br>")
            elif kind < 0.84:
                out.append(f"<{(h := self.r.choice(['h2', 'h3']))}>{say(self.words(self.r.randint(1, 6)))}</{h}>")
            elif kind < 0.90:
                out.append("<ul>" + "".join(f"<li>{say(self.words(self.r.randint(2, 15)))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote>{say(self.sentences())}</blockquote>")
            elif kind < 0.97:
                out.append(f"<pre>{say(self.sentences())}</pre>")
            else:
                out.append(f"<div>{say(self.sentences())}</div>")
            if self.r.random() < 0.12:
                other = self.r.choice([AD_WRAPS, SIDE_WRAPS, [("aside", "")], NOTE_WRAPS, COMMENT_WRAPS, [("form", "")], [("nav", "")],
                                       [("footer", "")]])
                out.append(self.wrap(other, self.r.choice(["{}", "<p>{}</p>"]).format(escape(self.sentences()))))
        return "".join(out)

    def page(self) -> tuple[str, set[str]]:
        main: set[str] = set()
        r = self.r
        tag, attrs = r.choice(MAIN_WRAPS[:2] + MAIN_WRAPS)
        body = f"<{tag}{attrs}>{self.article(main)}</{tag}>"
        if r.random() < 0.08:               # bare text, its lines broken by hand
            lines = [self.sentences() for _ in range(r.randint(1, 5))]
            main = {" ".join(" ".join(lines).split())}
            body = r.choice(["<br>", "<br><br>", "<br/>\n"]).join(escape(x, quote=False) for x in lines)
            body = r.choice(["{}", "{}", "<center>{}</center>", "<font size=3>{}</font>"]).format(body)
        elif r.random() < 0.06:             # columns of a table
            body = f'<table><tr><td{r.choice(["", " class=menu"])}>{self.links()}</td><td>{self.article(main := set())}</td></tr></table>'
        elif r.random() < 0.15:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{body}</div>'
        before, after = [], []
        for wraps, odds, inner in (
                (HEAD_WRAPS, 0.4, lambda: f"<h2>{self.words(3)}</h2>" + r.choice(["", f"<p>{self.words(8)}</p>"])),
                (MENU_WRAPS, 0.9, self.links),
                (NOTE_WRAPS, 0.4, lambda: f"<p>{self.sentences()}</p>" + r.choice(["", "We use cookies. Accept"])),
                (AD_WRAPS, 0.7, lambda: r.choice(["{}", "<p>{}</p>"]).format(escape(self.sentences())))):
            if r.random() < odds:
                (before if r.random() < 0.9 else after).append(self.wrap(wraps, inner()))
        for wraps, odds, inner in (
                (SIDE_WRAPS, 0.5, lambda: f"<h3>{self.words(2)}</h3>" + r.choice([self.links(), f"<p>{self.sentences()}</p>"])),
                ([("form", ""), ("form", ' class="search"')], 0.4,
                 lambda: f"<label>{self.words(2)}</label><input><p>{self.words(6)}.</p><button>{self.words(1)}</button>"),
                (COMMENT_WRAPS, 0.4, lambda: "".join(
                    f"<{t}>{escape(self.sentences())}</{t}>" for t in [r.choice(["p", "li", "div"])] * r.randint(1, 4))),
                (AD_WRAPS, 0.2, lambda: escape(self.sentences())),
                (FOOT_WRAPS, 0.9, lambda: r.choice(["&copy; ", "Copyright ", ""]) + "site.example &middot; " + self.sentences())):
            if r.random() < odds:
                (after if r.random() < 0.9 else before).append(self.wrap(wraps, inner()))
        html = (f"<!DOCTYPE html><html><head><title>{self.words(5)}</title><style>p{{margin:0}}</style></head><body>"
                + "".join(before) + body + "".join(after))
        return html + ("</body></html>" if r.random() < 0.9 else ""), main


def labelled_pages(n: int = N_PAGES, seed: int = 7) -> list[tuple[str, set[str]]]:
    """(html, texts of the blocks of the main text)."""
    writer = Writer(seed)
    return [writer.page() for _ in range(n)]
