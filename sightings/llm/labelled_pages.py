"""Labelled pages that the extraction of operator 12 is trained on: layouts in use on the web, filled with invented words.

A page is put together by rule from parts: a frame (semantic elements, classes and ids, tables, or none), what stands
around the main text and inside it, and the main text itself.  Elements of the main text carry ``data-main="1"``,
others inside them ``data-main="0"``.  Texts of both kinds are drawn alike, so that a page's build tells them apart
and not its words; sizes and stops differ only as they do on pages (links in menus, short lines in footers).
"""

from __future__ import annotations

import random
from html import escape

PAGES, SEED = 1200, 12
# How pages name their parts, in classes and ids.
MAIN_NAMES = """article article-body article-content article__body articleBody body-text content content-body entry entry-content field-body
 main main-content mainContent news-text page-content post post-body post-content post__content prose rich-text single story story-body text
 text-block blog-post detail document markdown-body mw-parser-output""".split()
ASIDE_NAMES = """sidebar side-bar aside left-column rail right-rail widget widget-area secondary related related-posts relatedArticles recommended
 recommendations more-stories read-more trending popular most-read teaser teasers infobox-links links toc""".split()
MENU_NAMES = """menu main-menu nav navbar nav-bar navigation topnav top-menu mainNav site-nav menu-item dropdown breadcrumb breadcrumbs pagination pager
 tabs toolbar skip-link language-switch category-list tags tag-list tag-cloud""".split()
HEADER_NAMES = "header site-header page-header masthead top topbar top-bar branding logo site-title hero-nav".split()
FOOTER_NAMES = "footer site-footer page-footer bottom bottom-bar copyright colophon legal imprint credits foot".split()
AD_NAMES = """ad ads adv advert advertisement ad-slot ad-container ad-banner adsbox adsense banner sponsor sponsored sponsored-content promo promotion
 promoted dfp commercial partner affiliate""".split()
NOTICE_NAMES = """cookie cookie-banner cookie-notice cookieConsent consent gdpr notice site-notice alert alert-box popup modal overlay paywall
 newsletter newsletter-signup subscribe subscription privacy-notice message disclaimer warning-box announcement""".split()
SHARE_NAMES = "share share-buttons social social-links socialShare follow-us buttons print-links tools actions".split()
COMMENT_NAMES = """comments comment comment-list commentList comment-body commentlist reader-comments user-comments responses response reply replies
 respond discussion disqus disqus_thread feedback reviews""".split()
FORM_NAMES = "search search-form searchbox login login-form signup contact-form comment-form poll form".split()
_SYLLABLES = "al an ar be bra co da de di el en er est fa ga ge hu il in ka la le lo ma mi na ne no on or pa pe qui ra re ri sa se si ta te ti to tor un ur va ve vi wa zu über é ñ ção".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def pick(self, names: list[str]) -> str:
        return self.rng.choice(names)

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        some = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        for i in range(3, len(some) - 1, 1):
            if rng.random() < 0.1:
                some[i] += rng.choice([",", ",", ".", ";", " &", " <", "!"])
        return escape(" ".join(some).capitalize(), quote=False)

    def sentence(self, low: int = 2, high: int = 40) -> str:
        return self.words(low, high) + self.rng.choice([".", ".", ".", "!", "?", "", ":"])

    def inline(self, text: str) -> str:
        """The text, at times with inline markup in it, not always closed."""
        parts = text.split(" ")
        if self.rng.random() < 0.35 and len(parts) > 2:
            i = self.rng.randrange(len(parts) - 1)
            tag = self.rng.choice(["b", "i", "em", "strong", "span", "a"])
            start = '<a href="/x">' if tag == "a" else f"<{tag}>"
            parts[i] = start + parts[i] + (f"</{tag}>" if tag == "a" or self.rng.random() < 0.8 else "")
        return (" <br>" if self.rng.random() < 0.1 else " ").join(parts)

    def attributes(self, names: list[str], extra: str = "") -> str:
        kind = self.rng.random()
        name = self.pick(names)
        if self.rng.random() < 0.3:
            name += f" {self.rng.choice(['clearfix', 'row', 'col-8', 'box', 'wrapper', 'inner', 'js-x', 'block', 'mt-3'])}"
        return (f' class="{name}"' if kind < 0.6 else f' id="{name.split(" ")[0]}"' if kind < 0.85 else f' class="{name}" id="{self.pick(names)}"') + extra

    def links(self, names: list[str], tag: str = "div") -> str:
        rng, tag = self.rng, self.rng.choice([tag, tag, "div"])
        items = [f'<a href="/{i}">{self.words(1, 5)}</a>' for i in range(rng.randint(2, 9))]
        style = rng.random()
        if style < 0.6:
            end = "</li>" if rng.random() < 0.7 else ""
            inner = f"<{rng.choice(['ul', 'ul', 'ol'])}>" + "".join(f"<li>{x}{end}" for x in items) + "</ul>"
        elif style < 0.8:
            inner = " | ".join(items)
        else:
            inner = "".join(f"<div>{x}</div>" for x in items)
        bare = tag not in ("div", "section") and rng.random() < 0.5
        return f"<{tag}{'' if bare else self.attributes(names)}>{inner}</{tag}>"

    def lines(self, names: list[str], tag: str = "div", low: int = 1, high: int = 3) -> str:
        """Sentences as of an advert, a notice or a footer."""
        rng, tag = self.rng, self.rng.choice([tag, tag, "div"])
        bare = tag not in ("div", "section", "p") and rng.random() < 0.5
        some = [self.sentence(1, 30) for _ in range(rng.randint(low, high))]
        if rng.random() < 0.4:
            inner = " ".join(some)
        else:
            inner = "".join(f"<{x}>{s}</{x}>" for s in some for x in [rng.choice(["p", "p", "div", "span", "h3", "h4"])])
        return f"<{tag}{'' if bare else self.attributes(names)}>{inner}</{tag}>"

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>"
        if self.rng.random() < 0.3:
            inner += f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><p>{self.sentence(2, 12)}</p>"
        return f"<form{self.attributes(FORM_NAMES) if self.rng.random() < 0.7 else ''}>{inner}</form>"

    def comments(self) -> str:
        rng = self.rng
        one = lambda: rng.choice([
            f'<div class="{rng.choice(["comment", "comment-body", "reply"])}"><b>{self.words(1, 2)}</b> <p>{self.sentence(2, 60)}</p></div>',
            f'<li class="comment"><p>{self.sentence(2, 60)}</p><p>{self.sentence(2, 40)}</p></li>',
            f'<article class="comment"><header>{self.words(1, 2)}</header><p>{self.sentence(2, 60)}</p></article>',
            f"<p>{self.sentence(2, 60)}</p>",
        ])
        head = f"<h{rng.randint(2, 4)}>{self.words(1, 3)}</h3>" if rng.random() < 0.7 else ""
        tail = self.form() if rng.random() < 0.4 else ""
        tag = rng.choice(["section", "div", "div", "aside"])
        return f"<{tag}{self.attributes(COMMENT_NAMES)}>{head}{''.join(one() for _ in range(rng.randint(1, 6)))}{tail}</{tag}>"

    def advert(self) -> str:
        return self.lines(AD_NAMES, self.rng.choice(["div", "div", "aside", "section"]))

    def notice(self) -> str:
        return self.lines(NOTICE_NAMES, self.rng.choice(["div", "div", "section", "dialog", "aside"]))

    def inside(self) -> str:
        """What may stand within the main text's element without being part of it."""
        made = self.rng.choice([
            self.advert, self.advert, self.notice, self.form, lambda: self.links(ASIDE_NAMES, "aside"), lambda: self.lines(ASIDE_NAMES, "aside"),
            lambda: self.links(SHARE_NAMES), lambda: self.links(MENU_NAMES, "nav"), self.comments, lambda: self.lines(FOOTER_NAMES, "footer"),
        ])()
        tag, _, rest = made.partition(made[1:].split(" ")[0].split(">")[0])
        return f'{tag}{made[1:].split(" ")[0].split(">")[0]} data-main="0"{rest}'

    def paragraph(self) -> str:
        rng, kind = self.rng, self.rng.random()
        text = self.inline(self.sentence(1, rng.choice([4, 20, 60, 160])))
        if kind < 0.72:
            return f"<p>{text}" + ("</p>" if rng.random() < 0.85 else "")
        if kind < 0.8:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.sentence(1, 20))}</li>" for _ in range(rng.randint(1, 6))) + f"</{tag}>"
        if kind < 0.86:
            return f"<blockquote>{text}</blockquote>" if rng.random() < 0.5 else f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.9:
            return f"<figure><img src=x><figcaption>{text}</figcaption></figure>"
        if kind < 0.94:
            rows = "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4)))
            return f"<table>{rows}</table>"
        return f"<pre>{text}</pre>" if kind < 0.96 else f"<div>{text}</div>" if kind < 0.99 else f"<dl><dt>{self.words(1, 3)}<dd>{text}</dl>"

    def body(self, noise: float) -> str:
        """Heading and paragraphs, now and then with something else between them."""
        rng = self.rng
        heading = f"<h1>{self.words(1, 12)}</h1>"
        if rng.random() < 0.15:
            heading = f"<header>{heading}</header>"
        out = [heading if rng.random() < 0.85 else ""]
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            if rng.random() < 0.12:
                out.append(f"<h{(n := rng.randint(2, 4))}>{self.words(1, 8)}</h{n}>")
            out.append(self.paragraph())
            if rng.random() < noise:
                out.append(self.inside())
        return "".join(out)

    def main(self) -> str:
        """The main text in an element of its own, at times in several."""
        rng, kind = self.rng, self.rng.random()
        noise = rng.choice([0, 0, 0.08, 0.2])
        body = self.body(noise)
        if kind < 0.4:
            return f'<article data-main="1"{self.attributes(MAIN_NAMES) if rng.random() < 0.4 else ""}>{body}</article>'
        if kind < 0.55:
            return f'<main data-main="1"{self.attributes(MAIN_NAMES) if rng.random() < 0.4 else ""}>{body}</main>'
        if kind < 0.65:
            return f'<main><article data-main="1">{body}</article></main>'
        if kind < 0.72:
            return f'<section data-main="1"{self.attributes(MAIN_NAMES)}>{body}</section>'
        if kind < 0.9:
            return f'<div data-main="1"{self.attributes(MAIN_NAMES)}>{body}</div>'
        return f'<div{self.attributes(MAIN_NAMES)}><div data-main="1"{self.attributes(MAIN_NAMES)}>{body}</div></div>'

    def page(self) -> str:
        rng = self.rng
        head = f'<!DOCTYPE html><html lang="{rng.choice(["en", "de", "fr", "es"])}"><head><meta charset="utf-8"><title>{self.words(1, 8)}</title>'
        head += f"<style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body{self.attributes(['page', 'home', 'single', 'post-template']) if rng.random() < 0.2 else ''}>"
        before = [
            (0.5, lambda: self.links(MENU_NAMES, "nav")), (0.35, lambda: self.lines(HEADER_NAMES, "header")), (0.15, lambda: self.links(HEADER_NAMES, "header")),
            (0.3, self.advert), (0.25, self.notice), (0.2, self.form), (0.15, lambda: self.links(MENU_NAMES)), (0.15, lambda: self.links(ASIDE_NAMES, "aside")),
            (0.1, lambda: f"<!-- {self.words(1, 3)} -->"),
        ]
        after = [
            (0.3, self.advert), (0.35, self.comments), (0.3, lambda: self.links(ASIDE_NAMES, "aside")), (0.2, lambda: self.lines(ASIDE_NAMES, "aside")),
            (0.2, lambda: self.links(SHARE_NAMES)), (0.15, self.notice), (0.15, self.form), (0.5, lambda: self.lines(FOOTER_NAMES, "footer", 1, 2)),
            (0.3, lambda: self.links(FOOTER_NAMES, "footer")),
            (0.2, lambda: f"<footer>&copy; {self.words(1, 2)} &middot; {self.sentence(1, 12)}</footer>"),
        ]
        drawn = lambda parts: [make() for chance, make in parts if rng.random() < chance]
        first, last = drawn(before), drawn(after)
        rng.shuffle(first)
        kind = rng.random()
        if kind < 0.06:  # nothing around the main text
            inner = f'<div data-main="1">{self.body(0)}</div>' if rng.random() < 0.5 else self.body(0).replace("<p>", '<p data-main="1">').replace("<h1>", '<h1 data-main="1">')
            return head + (inner if "data-main" in inner else f'<div data-main="1">{inner}</div>')
        if kind < 0.12:  # a table as the page's frame
            side, foot = "".join(first), "".join(last)
            return f'{head}<table><tr><td>{side}</td><td><div data-main="1"{self.attributes(MAIN_NAMES)}>{self.body(0.05)}</div></td></tr></table>{foot}'
        middle = self.main()
        if rng.random() < 0.4:
            wrapper = rng.choice(["container", "wrapper", "page", "site", "layout", "grid", "row"])
            middle = f'<div class="{wrapper}">{middle}' + ("".join(last) + "</div>" if rng.random() < 0.5 else "</div>" + "".join(last))
        else:
            middle += "".join(last)
        return head + "".join(first) + middle + ("</body></html>" if rng.random() < 0.9 else "")


def labelled_pages(many: int = PAGES, seed: int = SEED) -> list[str]:
    """So many pages, the same for the same seed."""
    writer = _Writer(random.Random(seed))
    return [writer.page() for _ in range(many)]
