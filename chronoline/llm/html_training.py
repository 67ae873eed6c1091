"""Synthetic pages with known main blocks, to train the block labeller here.

A page is laid out from furniture (menus, headers, notices, adverts, sidebars, forms, reader
comments, footers) around an article, with the element and class names that web pages
commonly use. The start of each main block carries MARK, which is taken off again after parsing.
"""

from __future__ import annotations

import random

from chronoline.llm.html_blocks import Block, leaf_blocks

MARK = ""
SYLLABLES = "an be con de en er es est for ge ha in ion ka la le ment mi nd ng on or os pa que ra re sch se st ta te th ti tion un ver wh ó é è ü ß ñ".split()
SHORT = "the of and to a in is de la le les et des der die und den von el los que en y".split()

#: Usual names of page parts, by part; used as class or id on neutral elements.
NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu tabs toc pagination pager".split(),
    "header": "header masthead topbar banner logo site-header branding page-header site-title".split(),
    "notice": "notice cookie cookies consent gdpr alert message popup modal overlay disclaimer warning paywall cookie-banner".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsbox adslot ad-slot commercial".split(),
    "sidebar": "sidebar side aside widget related recommended more trending popular links blogroll tags share social author-box".split(),
    "form": "form search newsletter subscribe signup login contact search-form".split(),
    "comments": "comments comment respond replies discussion reader-comments disqus comment-list thread feedback".split(),
    "footer": "footer copyright legal bottom site-footer colophon footnote credits".split(),
}
TAGS = {
    "menu": ["nav", "div", "ul", "nav"], "header": ["header", "div", "header"], "notice": ["div", "section", "aside", "p"],
    "advert": ["div", "aside", "section", "p"], "sidebar": ["aside", "div", "section", "aside"], "form": ["form", "form", "div"],
    "comments": ["section", "div", "ul", "ol"], "footer": ["footer", "div", "footer"],
}
MAIN_NAMES = "content main article post entry body text story article-body post-content entry-content main-content page-content".split()


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return self.r.choice(SHORT) if self.r.random() < 0.3 else "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        return (" ".join(self.word() for _ in range(self.r.randint(low, high)))).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def prose(self, sentences: int) -> str:
        text = " ".join(self.sentence() for _ in range(sentences))
        odd = self.r.random()
        if odd < 0.08:
            text = " ".join(w + self.r.choice(["***", "###", "%%%", "$$$", "&amp;&amp;"]) for w in text.split())
        elif odd < 0.14:
            text = " | ".join(text.split())
        elif odd < 0.2:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif odd < 0.25:
            text = " ".join(w for w in text.split() for _ in range(5))
        return text

    def wrap(self, part: str, inner: str) -> str:
        tag = self.r.choice(TAGS[part])
        semantic = tag in ("nav", "header", "aside", "form", "footer")
        named = "" if semantic and self.r.random() < 0.6 else f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(NAMES[part])}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    def furniture(self, part: str) -> str:
        r = self.r
        link = lambda: f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(r.randint(1, 3)))}</a>'
        if part == "menu":
            return self.wrap(part, "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>")
        if part == "header":
            return self.wrap(part, r.choice([f"<p>{self.sentence(2, 6)}</p>", f"<div>{link()}</div>", f"<h1>{self.word()}</h1><p>{self.sentence(3, 7)}</p>", self.sentence(2, 5)]))
        if part == "notice":
            return self.wrap(part, r.choice([self.sentence(5, 16), f"<p>{self.prose(2)}</p><button>{self.word()}</button>"]))
        if part == "advert":
            return self.wrap(part, r.choice([self.sentence(3, 16), f"<p>{self.prose(2)}</p>", f"<div>{link()}</div><p>{self.sentence()}</p>"]))
        if part == "sidebar":
            items = "".join(r.choice([f"<li>{link()}</li>", f"<p>{self.sentence()}</p>"]) for _ in range(r.randint(1, 6)))
            return self.wrap(part, f"<h3>{self.sentence(1, 3)}</h3>{items}")
        if part == "form":
            return self.wrap(part, f"<label>{self.word()}</label><input type=text><p>{self.sentence(2, 9)}</p><button>{self.word()}</button>")
        if part == "comments":
            one = lambda: f'<{(t := r.choice(["div", "li", "p", "article"]))}><b>{self.word()}</b> {self.prose(r.randint(1, 3))}</{t}>'
            return self.wrap(part, f"<h3>{self.sentence(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))))
        return self.wrap(part, r.choice([f"&copy; {self.word()}.example &middot; {self.sentence()}", f"<p>{self.prose(1)}</p>" + link(), f"<p>&copy; {r.randint(1999, 2030)} {self.word()}</p>"]))

    def article(self) -> str:
        r = self.r
        out = [f"<h1>{MARK}{self.sentence(2, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            text = MARK + self.prose(r.choice([1, 1, 2, 3, 5, 8]))
            if kind < 0.1:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.16:
                out.append(f"<h2>{MARK}{self.sentence(1, 6)}</h2>")
            elif kind < 0.22:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.sentence()}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.26:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.3:
                out.append(f"<div>{text}</div>")
            elif kind < 0.42:
                out.append(f"<p>{MARK}{' '.join(self.word() for _ in range(r.choice([1, 1, 1, 2, 3]))).capitalize()}{r.choice(['.', '.', '!', ''])}</p>")
            else:
                out.append(f"<p>{text}</p>")
            if r.random() < 0.06:
                out.append(self.furniture(r.choice(["advert", "notice", "form", "sidebar"])))
        if r.random() < 0.1:
            out.append(self.furniture("comments"))
        inner, kind = "".join(out), r.random()
        if kind < 0.45:
            return f"<article>{inner}</article>"
        if kind < 0.6:
            return f"<main>{inner}</main>"
        if kind < 0.9:
            return f'<div {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}">{inner}</div>'
        return inner

    def page(self) -> str:
        r = self.r
        some = lambda parts, p: "".join(self.furniture(x) for x in parts if r.random() < p)
        before = some(r.sample(["menu", "header", "notice", "advert", "form", "sidebar"], 6), 0.4)
        after = some(r.sample(["sidebar", "comments", "notice", "advert", "form", "menu"], 6), 0.3) + some(["footer"], 0.85)
        body = before + self.article() + after
        if r.random() < 0.3:
            body = f'<div id="{r.choice(["wrapper", "page", "container"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    maker, found = PageMaker(seed), []
    while len(found) < n:
        blocks = leaf_blocks(maker.page())
        labels = [int(MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "")
        if blocks:
            found.append((blocks, labels))
    return found
