"""Main texts of web pages by composite text density.

A page becomes a table of nodes in page order: parent, tag, and what the subtree holds of characters, tags, link characters and link tags.
A node's density is its characters for each tag, weighted by a logarithm that falls with the share of links in it and that is set
by the share of links in the whole body. A node's density sum adds up its children. The subtree of the largest density sum is the
article's core; the least density on the path from the body to it is the threshold that other nodes must reach to be taken too,
each by the subtree of its own largest density sum. Elements that can't be an article's own text (menus, forms, scripts, asides) are taken
out before densities are computed. Pages are independent, so nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content isn't markup, elements without content, elements that begin a block, and blocks that end an open paragraph.
RAW = "script|style|textarea|title|noscript|iframe|noembed|noframes|xmp|template|svg|math"
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
AROUND_PARAGRAPH = BLOCKS - {"p"}
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption html legend optgroup option summary tbody td tfoot th thead tr".split())
#: An element of the first kind ends an open one of the second, if none of the third lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
#: An end tag doesn't reach beyond the cell or table that it is in; one of an inline element not beyond the block.
CELLS = frozenset(("td", "th", "table"))
_WALLS = dict.fromkeys(("table", "body", "html"), frozenset()) | dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot"), frozenset(("table",)))
#: Elements that never hold an article's text, roles that say the same of others, and words of class or id, whole or by their beginning.
NOISE_TAGS = frozenset("head nav footer aside form button select input menu dialog search object audio video canvas label fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adsense adslot adsbygoogle alert consent copyright feedback gdpr login masthead menu menus modal nav navbar navigation notice notices outbrain overlay "
    "pagination pager paywall popup popups rail related replies reply respond responses rss share sharing signup skip social taboola tagcloud toolbar tracking "
    "trending widget widgets".split()
)
NOISE_STARTS = tuple("advert breadcrumb comment cookie disqus footer newsletter promo recommend sidebar sponsor subscri".split())
#: Words that say noise unless a word of the second kind stands beside them, and what comes before the name of something that is elsewhere.
WEAK_WORDS = frozenset("header banner links tags teaser teasers".split())
CONTENT_WORDS = frozenset("article content entry main post story".split())
_ELSEWHERE = re.compile(r"\b(?:has|with|no|without|hide|show)[-_]?[A-Za-z]+", re.I)
KEPT_TAGS = frozenset(("html", "body", "main"))
#: Open elements beyond which what starts counts as content of the innermost, as browsers have it.
DEEPEST = 512
#: A list or group of links: so many links, which are so much of its characters.
LINKS, LINK_SHARE = 3, 0.6

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<name>/?[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""[\s/](class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CASE, _WORD, _SPACE = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[A-Za-z]+"), re.compile(r"\s+")


@dataclass
class Page:
    """Nodes in page order; node 0 is the root. Texts belong to the node that they are directly in."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [0])
    noise: list[bool] = field(default_factory=lambda: [False])
    #: (node, text, whether a block begins before it), in page order
    texts: list[tuple[int, str, bool]] = field(default_factory=list)


def _is_noise(tag: str, rest: str) -> bool:
    if tag in NOISE_TAGS:
        return True
    if tag in KEPT_TAGS or "=" not in rest and "hidden" not in rest:
        return False
    words = set()
    for m in _NAMED.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name == "role" and value.lower() in NOISE_ROLES:
            return True
        if name in ("class", "id"):
            words.update(w.lower() for w in _WORD.findall(_CASE.sub(" ", _ELSEWHERE.sub(" ", value))))
    return bool(words & NOISE_WORDS or words & WEAK_WORDS and not words & CONTENT_WORDS) or any(w.startswith(NOISE_STARTS) for w in words)


def parse(html: str) -> Page:
    """Nodes and texts of a page of any quality: what isn't closed ends with what is around it, and ends without a start mean nothing."""
    page, open_, at, fresh = Page(), [0], 0, True

    def end(depth: int) -> None:
        nonlocal fresh
        fresh = fresh or any(page.tag[n] in BLOCKS for n in open_[depth:])
        del open_[depth:]

    def close(tags: set[str], within: frozenset[str] | set[str]) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            name = page.tag[open_[depth]]
            if name in tags:
                return end(depth)
            if name in within:
                return

    def text(upto: int) -> None:
        nonlocal fresh
        if upto > at:
            found = html[at:upto]
            page.texts.append((open_[-1], unescape(found) if "&" in found else found, fresh))
            fresh = False

    for m in _TOKEN.finditer(html):
        text(m.start())
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name[0] == "/":
            name = name[1:]
            if name == "br":
                page.texts.append((open_[-1], " ", fresh))
            elif name not in EMPTY:
                close({name}, _WALLS.get(name, CELLS if name in BLOCKS else BLOCKS))
            continue
        if name == "br":
            page.texts.append((open_[-1], " ", False))
        if name in ENDS_PARAGRAPH:
            close({"p"}, AROUND_PARAGRAPH)
        if name in ENDS:
            close(*ENDS[name])
        if name in ("html", "body") and name in (page.tag[n] for n in open_):
            continue
        fresh = fresh or name in BLOCKS
        page.tag.append(name)
        page.parent.append(open_[-1])
        page.noise.append(_is_noise(name, m["rest"] or ""))
        if len(open_) < DEEPEST and name not in EMPTY and (name in BLOCKS or not (m["rest"] or "").endswith("/")):
            open_.append(len(page.tag) - 1)
    text(len(html))
    return page


class Densities:
    """Characters, tags, link characters and link tags of every subtree without its noise, its density and its density sum."""

    def __init__(self, page: Page):
        n = len(page.tag)
        self.page, self.gone = page, [False] * n
        parent, tag = page.parent, page.tag
        self.linked = [False] * n
        for i in range(n):
            up = parent[i]
            self.gone[i] = page.noise[i] or i > 0 and (self.gone[up] or tag[i] == "header" and not self._headline(up))
            self.linked[i] = tag[i] == "a" or i > 0 and self.linked[up]
        self._count()
        self._without_menus()
        self._count()
        body = next((i for i in range(n) if tag[i] == "body" and not self.gone[i]), 0)
        self.body = body
        share = self.link_chars[body] / max(self.chars[body], 1)
        self.density = [0.0 if self.gone[i] else self._density(i, share) for i in range(n)]
        self.sum = [0.0] * n
        for i in range(1, n):
            self.sum[parent[i]] += self.density[i]

    def _headline(self, up: int) -> bool:
        """An article's own header is text of it; a page's isn't."""
        while up:
            if self.page.tag[up] in ("article", "main"):
                return True
            up = self.page.parent[up]
        return False

    def _count(self) -> None:
        page, n = self.page, len(self.page.tag)
        self.chars, self.tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text, _ in page.texts:
            if not self.gone[node]:
                size = len(text) if "  " not in text and "\n" not in text else len(_SPACE.sub(" ", text).strip())
                self.chars[node] += size
                if self.linked[node]:
                    self.link_chars[node] += size
        for i in range(n - 1, 0, -1):
            up = page.parent[i]
            if not self.gone[i]:
                self.chars[up] += self.chars[i]
                self.link_chars[up] += self.link_chars[i]
                self.tags[up] += self.tags[i] + 1
                self.link_tags[up] += self.link_tags[i] + (page.tag[i] == "a")

    def _without_menus(self) -> None:
        """Lists and groups that are links and little else are menus."""
        page = self.page
        for i in range(1, len(page.tag)):
            menu = page.tag[i] in ("ul", "ol", "dl", "div", "table", "p", "section", "td") and self.link_tags[i] >= LINKS and self.link_chars[i] >= LINK_SHARE * self.chars[i]
            self.gone[i] = self.gone[i] or menu or self.gone[page.parent[i]]

    def _density(self, i: int, share: float) -> float:
        c, t, lc, lt = self.chars[i], max(self.tags[i], 1), self.link_chars[i], self.link_tags[i]
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1) / math.log(base + 1)

    def core(self) -> int:
        """The node of the largest density sum; of equals the first."""
        return self._best(self.body, len(self.page.tag))

    def _best(self, first: int, end: int) -> int:
        best = first
        for i in range(first, end):
            if not self.gone[i] and self.sum[i] > self.sum[best]:
                best = i
        return best

    def path(self, node: int) -> list[int]:
        out = [node]
        while node != self.body and node:
            node = self.page.parent[node]
            out.append(node)
        return out

    def taken(self) -> list[bool]:
        """Whether each node's own text is the article's."""
        page, n = self.page, len(self.page.tag)
        core = self.core()
        path = self.path(core)
        on_path = set(path)
        article = [i for i in path if page.tag[i] == "article"] or [i for i in path if page.tag[i] == "main"]
        whole = [False] * n
        if article:
            whole[article[-1]] = True
        else:
            least = min(self.density[i] for i in path)
            whole[core] = True
            last = self._ends()
            after = 0
            for i in range(self.body, n):  # the highest nodes that reach the threshold; what they take is not looked into again
                if i >= after and not self.gone[i] and i not in on_path and self.density[i] >= least:
                    best = self._best(i, last[i] + 1)
                    whole[best if self.sum[best] > 0 else i] = True
                    after = last[i] + 1
            self._fill(whole, [i for i in path[1:] if i != self.body])
        for i in range(1, n):
            whole[i] = (whole[i] or whole[page.parent[i]]) and not self.gone[i]
        return whole

    def _fill(self, whole: list[bool], around: list[int]) -> None:
        """What stands between two parts of the article, or is a heading, in an element that holds the core is the article's too, however short."""
        parent, tag = self.page.parent, self.page.tag
        holds = [False] * len(tag)
        for i in range(len(tag) - 1, 0, -1):
            holds[i] = holds[i] or whole[i]
            holds[parent[i]] = holds[parent[i]] or holds[i]
        inside: dict[int, list[int]] = {i: [] for i in around}
        for i in range(1, len(tag)):
            if parent[i] in inside:
                inside[parent[i]].append(i)
        for children in inside.values():
            found = [i for i in children if holds[i]]
            for i in children:
                whole[i] = whole[i] or not holds[i] and (found[0] < i < found[-1] or re.fullmatch("h[1-6]", tag[i]) is not None)

    def _ends(self) -> list[int]:
        """The last node of each subtree."""
        last = list(range(len(self.page.tag)))
        for i in range(len(last) - 1, 0, -1):
            last[self.page.parent[i]] = max(last[self.page.parent[i]], last[i])
        return last


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, one to a line. Null and empty pages, and pages without text, give the empty text."""
    page = parse(html or "")
    found = Densities(page)
    taken, lines, line = found.taken(), [], []
    for node, text, fresh in page.texts:
        if fresh and line:
            lines.append("".join(line))
            line = []
        if taken[node]:
            line.append(text)
    lines.append("".join(line))
    return "\n".join(x for x in (_SPACE.sub(" ", x).strip() for x in lines) if x)


def texts_of(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in pages], pa.string())


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, url, text and n_chars of every page.

    Null and empty pages give the empty text, as do pages of menus only; null keys and addresses stay as they are; repeated rows come out
    alike, each; of subtrees with equal sums the first counts; other columns are ignored; an empty table gives no rows. A page is
    read whole by one task, however long.
    """
    kernel = F.arrow_udf(texts_of, "string")
    return pages.select(key, url, kernel(F.col(html)).alias("text")).select(key, url, "text", F.char_length("text").cast("long").alias("n_chars"))
