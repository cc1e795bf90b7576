"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A tolerant parser turns a page into its block elements (and inline ones whose attributes tell
something). For each, the trees see the density of its subtree, its tag, depth, attribute
tokens, ancestors and siblings, and give the odds that it belongs to the article. Decoding
chooses kept and dropped nodes together: below a dropped node nothing is kept, so the choice
that explains all nodes best decides whether a doubtful block goes with its container.

The trees are fitted on pages made by rule (fit() is deterministic); no page of the corpus is labelled.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from . import boosting

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)(?=[a-zA-Z]))")
_NAME = re.compile(r"[^\s/>]+")
#: What stands between a tag's name and its end, quoted values whole. Possessive: it never goes back.
_REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_STOPS = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|([^\s=/"'>]+)""")
_PART = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content a browser never shows as text: code, form values, and what stands in for media it can play.
RAW = frozenset("script style noscript template iframe object svg canvas audio video select textarea title head noframes".split())
_TO_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
BLOCK = frozenset(
    "html body article section main nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption blockquote pre form fieldset legend address details summary dialog hgroup menu search button label center".split()
)
#: An opening tag closes an open element of these at the top of the stack.
_CLOSES = {t: frozenset({"p"}) for t in BLOCK - {"html", "body", "button", "label"}}
_CLOSES |= {"li": frozenset({"p", "li"}), "dt": frozenset({"p", "dt", "dd"}), "dd": frozenset({"p", "dt", "dd"}), "tr": frozenset({"p", "td", "th", "tr"}), "td": frozenset({"p", "td", "th"}), "th": frozenset({"p", "td", "th"})}
_INLINE = "a b i u em strong span font small big code sub sup abbr cite q s strike mark time"
_FORMAT = frozenset(_INLINE.split())

TAGS = ("div p article section main nav header footer aside form ul ol li table td h1 h2 h3 blockquote pre figure figcaption body a button dl").split()
_TAG_ID = {t: i for i, t in enumerate(TAGS)}
#: Attribute tokens (of class, id and role) by what they say.
TOKENS = {
    "article": "article post entry content story text main maintext articlebody body blogpost",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs toolbar skip",
    "top": "header masthead banner topbar logo branding hero",
    "bottom": "footer foot copyright colophon legal",
    "side": "sidebar aside widget rail related recommended trending popular more teaser complementary",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense outbrain taboola dfp",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay newsletter subscribe signup paywall warning disclaimer",
    "comment": "comment comments reply replies respond discussion disqus thread reader feedback",
    "share": "share sharing social tags tag meta byline author tools actions print",
    "form": "form search login input contact poll survey",
}
_TOKEN_OF = {w: 1 << i for i, words in enumerate(TOKENS.values()) for w in words.split()}
_BAD_TAGS = {"nav": 1, "header": 2, "footer": 4, "aside": 8, "form": 16, "article": 32, "main": 64, "ul": 128, "ol": 128, "table": 256}


#: Log odds in favour of keeping a node whose container is kept (and is not the page's outermost).
STICK = 1.5
#: The least log odds of the block that is kept when all others go.
FLOOR = -3.0
#: Nodes whose feature rows stand in memory at once.
NODES = 1 << 15


class Ends:
    """Where the tags of a page end, in time linear in the page whatever its quotes.

    A tag ends at the first > outside quoted values; if there is none (a quote is never closed), at
    the first > at all. The quick way reads ahead once for each tag. Once it has run to the end of
    the page in vain, ends are found by walking from quote to quote, and each opening quote is
    walked from once.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.stops: list[int] | None = None
        self.after: dict[int, int] = {}  # opening quote: end of the tag, or -1

    def of(self, at: int) -> int:
        """The place behind the end of a tag whose name ends at a place before the last >."""
        if self.stops is None:
            m = _REST.match(self.html, at)
            if m:
                return m.end()
            self.stops = [m.start() for m in _STOPS.finditer(self.html, at)]
        end = self._walk(at)
        return end if end >= 0 else self.html.find(">", at) + 1

    def _walk(self, at: int) -> int:
        html, stops, walked = self.html, self.stops, []
        while True:
            i = bisect_left(stops, at)
            if i == len(stops):
                end = -1
                break
            stop = stops[i]
            if html[stop] == ">":
                end = stop + 1
                break
            if stop in self.after:
                end = self.after[stop]
                break
            walked.append(stop)
            close = html.find(html[stop], stop + 1)
            if close < 0:
                end = -1
                break
            at = close + 1
        for stop in walked:
            self.after[stop] = end
        return end


class Page:
    """A page's nodes in page order (parents first) and its pieces of text."""

    __slots__ = ("tag", "parent", "depth", "marks", "above", "tagged", "end", "pieces", "inline")

    def __init__(self, html: str):
        self.tag, self.parent, self.depth, self.marks, self.above, self.tagged, self.end, self.inline = [-1], [-1], [0], [0], [0], [0], [0], [0]
        self.pieces: list[tuple[int, str, bool]] = []  # node, text, in a link
        self._read(html)

    def _read(self, html: str) -> None:
        # the stack holds (tag, node) of open elements; inline ones without marks keep their parent's node
        stack: list[tuple[str, int]] = [("", 0)]
        places: dict[str, list[int]] = {}  # where in the stack the elements of a tag stand
        blocks: list[int] = []  # and where blocks do
        node, links, at, n = 0, 0, 0, len(html)
        pieces, ends = self.pieces, Ends(html)
        tag, parent, depth, marks, above, tagged, end, inline = self.tag, self.parent, self.depth, self.marks, self.above, self.tagged, self.end, self.inline

        def pop() -> None:
            nonlocal links
            t, k = stack.pop()
            places[t].pop()
            if t in BLOCK:
                blocks.pop()
            links -= t == "a"
            if k != stack[-1][1]:
                end[k] = len(tag)

        begin = 0  # of the text not yet told
        while True:
            i = html.find("<", at)
            m = _OPEN.match(html, i) if i >= 0 else None
            if i >= 0 and (m is None or (m[4] is not None and i > ends.last)):
                at = i + 1  # no tag: the character is text
                continue
            stop = i if i >= 0 else n
            if stop > begin:
                text = html[begin:stop]
                pieces.append((node, unescape(text) if "&" in text else text, links > 0))
            if i < 0:
                break
            if m[4] is None:
                mark = "-->" if m[1] else "]]>" if m[2] else ">"
                close = html.find(mark, m.end())
                at = begin = close + len(mark) if close >= 0 else n
                continue
            word = _NAME.match(html, m.end())
            at = begin = ends.of(word.end())
            name = word[0].lower()
            if m[4]:
                where = places.get(name)
                # a stray inline end tag closes no block
                if where and not (name in _FORMAT and blocks and blocks[-1] > where[-1]):
                    if name in BLOCK:
                        pieces.append((node, " ", False))
                    for _ in range(len(stack) - where[-1]):
                        pop()
                    node = stack[-1][1]
                continue
            attrs = html[word.end() : at - 1]
            if name in RAW:
                if name != "head" and not attrs.endswith("/"):
                    close = _TO_END[name].search(html, at)
                    at = begin = close.end() if close else n
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    pieces.append((node, " ", False))
                tagged[node] += 1
                continue
            if name in _CLOSES:
                pieces.append((node, " ", False))
                while len(stack) > 1 and (stack[-1][0] in _CLOSES[name] or (stack[-1][0] in _FORMAT and len(stack) > 2 and any(t in _CLOSES[name] for t, _ in stack[-4:-1]))):
                    pop()
                node = stack[-1][1]
            bits = 0
            if attrs and not attrs.isspace():
                for key, value, _alone in _ATTR.findall(attrs):
                    k = key.lower()
                    if k in ("class", "id", "role"):
                        for w in _PART.split(value.lower()):
                            bits |= _TOKEN_OF.get(w, 0)
                    elif k == "style" and "display:none" in value.replace(" ", "").lower():
                        bits |= 1 << 12
                    elif k == "aria-hidden" and "true" in value:
                        bits |= 1 << 12
                    if _alone.lower() == "hidden":
                        bits |= 1 << 12
            tagged[node] += 1
            if name in BLOCK or bits:
                mine = len(tag)
                tag.append(_TAG_ID.get(name, len(TAGS)))
                parent.append(node)
                depth.append(depth[node] + 1)
                marks.append(bits)
                above.append(above[node] | marks[node] << 10 | _BAD_TAGS.get(TAGS[tag[node]], 0) if 0 <= tag[node] < len(TAGS) else above[node] | marks[node] << 10)
                tagged.append(0)
                end.append(0)
                inline.append(name not in BLOCK)
                node = mine
            links += name == "a"
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append((name, node))
        for k in range(len(tag)):
            if not end[k]:
                end[k] = len(tag)


class Features:
    """The nodes' features, column by column; rows() puts a part of the nodes together."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(base[-1])
        flat = lambda k: np.fromiter((x for p in pages for x in getattr(p, k)), np.int64, n)
        tag, depth, marks, above, tagged, inline = (flat(k) for k in ("tag", "depth", "marks", "above", "tagged", "inline"))
        shift = np.repeat(base[:-1], sizes)
        parent, end = flat("parent"), flat("end") + shift
        root = parent < 0
        parent = np.where(root, np.arange(n), parent + shift)
        own = np.zeros((5, n))  # characters, in links, words, sentence marks, pieces
        for p, first in zip(pages, base[:-1].tolist()):
            for k, text, link in p.pieces:
                size = len(text)
                if size < 2 and text.isspace():
                    continue
                words = text.count(" ") + 1
                i = first + k
                own[0, i] += size
                own[1, i] += size * link
                own[2, i] += words
                own[3, i] += text.count(".") + text.count(",")
                own[4, i] += 1
        sums = np.concatenate([np.zeros((5, 1)), np.cumsum(own, axis=1)], axis=1)
        sub = sums[:, end] - sums[:, np.arange(n)]
        tags = np.concatenate([[0], np.cumsum(tagged)])
        sub_tags = tags[end] - tags[np.arange(n)]
        page = np.repeat(np.arange(len(pages)), sizes)
        total = sub[0, base[:-1]][page]
        kids = np.bincount(parent[~root], minlength=n)
        # place among siblings: rows are in page order, so a stable sort by parent lines siblings up
        order = np.argsort(parent, kind="stable")
        place = np.empty(n, np.int64)
        same = np.concatenate([[True], parent[order][1:] != parent[order][:-1]])
        place[order] = np.arange(n) - np.maximum.accumulate(np.where(same, np.arange(n), 0))
        before, after = np.zeros(n), np.zeros(n)
        mid = ~same[1:]
        before[order[1:][mid]] = sub[0][order[:-1][mid]]
        after[order[:-1][mid]] = sub[0][order[1:][mid]]
        _, kind, count = np.unique(parent * 64 + tag + 1, return_inverse=True, return_counts=True)
        alike = count[kind]
        self.base, self.tag, self.marks, self.above = base, tag, marks, above
        self.plain = [
            depth, kids, alike, place, place / np.maximum(1, kids[parent]), np.log1p(sub[0]), np.log1p(own[0]), np.log1p(sub[2]), sub[1] / np.maximum(1, sub[0]), own[1] / np.maximum(1, own[0]),
            sub[0] / (1 + sub_tags), sub[3] / np.maximum(1, sub[2]), sub[2] / np.maximum(1, sub[4]), sub[0] / np.maximum(1, total), sub[0] / np.maximum(1, sub[0][parent]), np.log1p(before), np.log1p(after),
            sub[1][parent] / np.maximum(1, sub[0][parent]), inline, np.arange(n) - base[:-1][page], (end - np.arange(n)),
        ]

    def rows(self, a: int, b: int) -> np.ndarray:
        """Feature rows of the nodes a to b."""
        cols = [c[a:b] for c in self.plain]
        cols += [self.tag[a:b] == i for i in range(len(TAGS))]
        cols += [self.marks[a:b] >> i & 1 for i in range(13)]
        cols += [self.above[a:b] >> i & 1 for i in range(23)]
        return np.stack([np.asarray(c, np.float64) for c in cols], axis=1)

    def log_odds(self, trees: boosting.Trees) -> np.ndarray:
        """The trees' verdict on every node; only NODES nodes' rows stand in memory at once."""
        n = int(self.base[-1])
        return np.concatenate([trees.log_odds(self.rows(a, min(n, a + NODES))) for a in range(0, n, NODES)])


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes are kept: the best labelling in which nothing is kept below a dropped node.

    Nodes without text below them have no say. The root is always kept. Of equally good labellings,
    the one that keeps more.
    """
    n = len(page.tag)
    some = [False] * n
    for k, text, _ in page.pieces:
        if not some[k] and text.strip():
            some[k] = True
    parent = page.parent
    body = _TAG_ID["body"]
    stick = [STICK if p > 0 and parent[p] > 0 and page.tag[p] != body else 0.0 for p in parent]
    for i in range(n - 1, 0, -1):
        if some[i]:
            some[parent[i]] = True
    odds = np.clip(odds, -8, 8)
    yes, no = (-np.log1p(np.exp(-odds))).tolist(), (-np.log1p(np.exp(odds))).tolist()
    kept, dropped = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if some[i]:
            kept[i] += yes[i]
            dropped[i] += no[i]
        if i:
            p = parent[i]
            kept[p] += max(kept[i] + stick[i], dropped[i])
            dropped[p] += dropped[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[parent[i]] and kept[i] + stick[i] >= dropped[i]
    if not any(out[k] and text.strip() for k, text, _ in page.pieces):
        # a page whose every block was doubtful: its best block, if that is no clear refusal
        best = max((i for i in range(1, n) if some[i]), key=lambda i: odds[i], default=0)
        while best and stick[best] and odds[parent[best]] > FLOOR:
            best = parent[best]  # with its container, where that is no clear refusal either
        if best and odds[best] > FLOOR:
            for i in range(best, page.end[best]):
                out[i] = i == best or (out[parent[i]] and kept[i] + stick[i] >= dropped[i])
            while parent[best] > 0:  # and so its containers
                best = parent[best]
                out[best] = True
    return out


def text_of(page: Page, kept: list[bool]) -> str:
    return " ".join("".join(text if kept[k] else " " for k, text, _ in page.pieces).split())


# -- pages made by rule --------------------------------------------------------------------


class _Maker:
    """Pages with known labels: what is written between keep(True) and keep(False) is the article's."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.told = False  # whether attributes must say what an element is

    def words(self, a: int, b: int) -> str:
        r = self.r
        out = ["".join(r.choice("bcdfghlmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))]
        for i in range(len(out) - 1):
            if r.random() < 0.08:
                out[i] += r.choice(",.;")
        return " ".join(out).capitalize() + r.choice([".", ".", ".", "", "!"])

    def attr(self, *names: str) -> str:
        r = self.r
        if not self.told and r.random() < 0.35:
            return r.choice(["", f' class="c{r.randint(1, 99)}"', f' id="x{r.randint(1, 99)}"'])
        return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.r.randint(1, 999)}">{self.words(1, 3)}</a></li>' for _ in range(n))

    def para(self) -> str:
        r, t = self.r, self.words(*self.r.choice([(1, 4), (2, 15), (10, 60), (40, 200)]))
        if r.random() < 0.2:
            w = t.split(" ")
            i = r.randrange(len(w))
            w[i] = r.choice(["<b>%s</b>", "<em>%s</em>", '<a href="/k">%s</a>', "<i>%s"]) % w[i]
            t = " ".join(w)
        if r.random() < 0.08:
            return f"<p><b>{t}<br>"
        return f"<p>{t}" + ("</p>" if r.random() < 0.9 else "")

    def body(self, depth: int = 0) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            title = self.words(1, 12)
            out.append(f"<h1>{title}</h1>")
            if r.random() < 0.3:
                out.append(r.choice(["<p>%s</p>", "<p><b>%s<br>", "<p><b>%s</b></p>", "<div>%s</div>"]) % title)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.72:
                out.append(self.para())
            elif x < 0.78:
                out.append(f"<h2>{self.words(1, 7)}</h2>")
            elif x < 0.83:
                out.append("<ul>" + "".join(f"<li>{self.words(3, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.86:
                out.append(f"<blockquote><p>{self.words(6, 40)}</p></blockquote>")
            elif x < 0.89:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif x < 0.91:
                out.append(f"<pre>{self.words(4, 30)}</pre>")
            elif x < 0.93:
                out.append(f'<figure><img src="a"><figcaption>{self.words(2, 10)}</figcaption></figure>')
            elif x < 0.95 and not depth:
                out.append(f"<section>{self.body(1)}</section>")
            else:
                out.append(f"<div>{self.para()}</div>")
            if r.random() < 0.06:
                self.told = True  # within an article, only its attributes or tag tell a foreign block
                out.append("\x02" + self.junk(True) + "\x01")
                self.told = False
        return "".join(out)

    def junk(self, inside: bool = False) -> str:
        r = self.r
        kinds = ["advert", "share", "notice", "related", "form", "toc"] if inside else ["advert", "notice", "aside", "related", "form", "share", "header", "menu", "crumbs", "comments", "script"]
        k = r.choice(kinds)
        tag = r.choice(["div", "div", "section", "p"])
        if k == "advert":
            return f"<{tag}{self.attr('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo box')}>{self.words(2, 25)}</{tag}>"
        if k == "share":
            return f"<div{self.attr('share', 'social', 'sharing tools', 'tags')}>" + "".join(f'<a href="#">{self.words(1, 1)}</a> ' for _ in range(r.randint(2, 5))) + "</div>"
        if k == "notice":
            return f"<{tag}{self.attr('cookie-notice', 'consent', 'notice', 'alert', 'newsletter', 'paywall')}>{self.words(5, 40)}{r.choice(['', '<button>Ok</button>'])}</{tag}>"
        if k == "aside":
            return f"<aside{self.attr('sidebar', 'widget', 'rail')}><h3>{self.words(1, 3)}</h3>{r.choice([f'<p>{self.words(4, 40)}</p>', f'<ul>{self.links(5)}</ul>'])}</aside>"
        if k == "related":
            return f"<{r.choice(['div', 'section', 'aside'])}{self.attr('related', 'recommended', 'more', 'teaser')}><h3>{self.words(1, 3)}</h3><ul>{self.links(r.randint(3, 8))}</ul></div>"
        if k == "form":
            return f"<form{self.attr('search', 'login', 'signup', 'contact')}><label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button></form>"
        if k == "toc" or k == "crumbs":
            return f"<{r.choice(['div', 'nav', 'ol'])}{self.attr('toc', 'breadcrumb', 'pagination')}>" + "".join(f'<a href="#">{self.words(1, 3)}</a> ' for _ in range(r.randint(2, 6))) + "</div>"
        if k == "header":
            return f"<header{self.attr('header', 'masthead', 'topbar')}><div>{self.words(1, 5)}</div>{r.choice(['', f'<p>{self.words(3, 12)}</p>'])}</header>"
        if k == "menu":
            t = r.choice(["nav", "div", "nav"])
            return f"<{t}{self.attr('nav', 'menu', 'navbar main-menu')}><ul>{self.links(r.randint(3, 12))}</ul></{t}>"
        if k == "comments":
            t = r.choice(["section", "div"])
            one = lambda: f"<{r.choice(['div', 'li', 'article'])}{self.attr('comment', 'reply', 'comment-body')}><b>{self.words(1, 2)}</b><p>{self.words(3, 50)}</p></div>"
            return f"<{t}{self.attr('comments', 'discussion', 'respond')}><h3>{self.words(1, 3)}</h3>{''.join(one() for _ in range(r.randint(1, 8)))}</{t}>"
        return '<script>var t="</p>";</script>'

    def page(self) -> str:
        """Private marks \x01 and \x02 stand where the article begins and ends."""
        r = self.r
        t = r.choice(["article", "article", "main", "div", "div", "section", "td"])
        core = f"<{t}{self.attr('article', 'content', 'post', 'entry-content', 'story', 'main text')}>\x01{self.body()}\x02"
        if r.random() < 0.25:
            self.told = True
            core += self.junk()
            self.told = False
        core += f"</{t}>"
        if t == "td":
            core = f"<table><tr>{core}<td\x02{self.attr('side', 'sidebar')}>{self.links(4)}</td></tr></table>"
        for _ in range(r.choice([0, 0, 1, 2])):
            core = f"<{r.choice(['div', 'main', 'section'])}{self.attr('wrapper', 'container', 'page', 'content')}>{core}{self.junk() if r.random() < 0.4 else ''}</div>"
        top = "".join(self.junk() for _ in range(r.randint(0, 3)))
        bottom = "".join(self.junk() for _ in range(r.randint(0, 3)))
        if r.random() < 0.8:
            top = f"<nav{self.attr('nav', 'menu')}><ul>{self.links(r.randint(3, 9))}</ul></nav>" + top
        if r.random() < 0.8:
            bottom += f"<footer{self.attr('footer', 'copyright')}>&copy; {self.words(2, 20)}</footer>"
        elif r.random() < 0.5:
            bottom += f"<div{self.attr('footer', 'copyright')}>&copy; {self.words(2, 20)}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{top}{core}{bottom}</body></html>"


def made_pages(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the nodes of pages made by rule. A node is the article's if most of its text is."""
    maker, xs, ys = _Maker(seed), [], []
    for _ in range(n):
        page = Page(maker.page().replace("<td\x02", "\x02<td"))
        good, every = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        inside, clean = False, []
        for k, text, link in page.pieces:
            for part in re.split("([\x01\x02])", text):
                if part in ("\x01", "\x02"):
                    inside = part == "\x01"
                else:
                    size = len(part.strip())
                    every[k] += size
                    good[k] += size * inside
            if text := text.replace("\x01", "").replace("\x02", ""):
                clean.append((k, text, link))
        page.pieces = clean
        x = Features([page]).rows(0, len(page.tag))
        sums = np.concatenate([[[0], [0]], np.cumsum([good, every], axis=1)], axis=1)
        end = np.array(page.end)
        g, e = sums[:, end] - sums[:, np.arange(len(end))]
        some = e > 0
        some[0] = False
        xs.append(x[some])
        ys.append((2 * g > e)[some].astype(float))
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=2)
def fit(pages: int = 700, seed: int = 11) -> boosting.Trees:
    x, y = made_pages(pages, seed)
    return boosting.fit(x, y)


def extract_pages(htmls: list[str], trees: boosting.Trees) -> list[str]:
    pages = [Page(h) for h in htmls]
    if not pages:
        return []
    found = Features(pages)
    odds, base = found.log_odds(trees), found.base
    return [text_of(p, decode(p, odds[a:b])) for p, a, b in zip(pages, base[:-1].tolist(), base[1:].tolist())]


def extract(df: DataFrame, trees: boosting.Trees, keep: list[str], html: str = "html") -> DataFrame:
    """Adds text and n_chars (its code points) to the columns keep.

    Null and empty pages give an empty text; repeated rows stay; an empty table gives no rows. Other
    columns, whatever their names, have no part. Time and memory grow with a page's length, however
    broken its markup is. Map only.
    """

    def kernel(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        raw, at = data.tobytes(), offsets.tolist()
        out: list[str] = []
        for i in range(0, len(at) - 1, 256):
            part = at[i : i + 257]
            out += extract_pages([raw[a:b].decode() for a, b in zip(part, part[1:])], trees)
        return {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}

    src = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{html}`").cast("string").alias("_html"))
    return K.map_text(src, kernel, "text string, n_chars long", keep, text="_html")
