"""Main text of web pages by composite text density.

A page is parsed into a tree the way browsers recover from missing end tags, as far as text extraction needs
it. Elements that hold no prose whatever is around them (scripts, styles, templates, controls of forms) are
left out. Every other node gets its composite density: characters per tag, scaled down by the logarithm of
its share of link characters and link tags. A node's density sum is that of its children. The node with the
largest sum is the core of the article; the least density on its path to the body is the threshold, at or
above which further subtrees with several text children count as parts of the article. A core is widened to
the article or main element, or to a parent, that holds little else. Inside the core, blocks below the
threshold that are mostly links are left out, but for a few links at the end. A first-level heading right before the article
belongs to it with its block.

What menus, headers, footers, asides, forms and dialogs are called, and words of class, id or role, are a weight
and no verdict: their text counts as if it were link text, which lowers its density. A name does not count
on what holds the article or main element or the first heading, nor where nearly all text of the page is
below that name ('layout has-sidebar', a form around the page).

Whole pages are read, nothing is capped; trees are walked without recursion. Each page is on its own, so
memory is that of one Arrow batch and one page.

Defined cases: a null page is empty; a page without text gives an empty text; references without a semicolon are
decoded as browsers do; an unclosed comment, tag or script runs to the end of the page; very long pages are read
whole; repeated rows come back as often; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt legend li optgroup option tbody td tfoot th thead tr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Start tags that end an open element, and where the search for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
SCOPE = frozenset("table td th caption button object template".split())
#: Elements that hold no prose.
NO_TEXT = RAW | frozenset("noscript template svg math canvas object audio video map button select datalist input".split())
#: Elements, and words of class, id or role, whose text weighs as link text.
MARK_TAGS = frozenset("nav footer aside header form menu dialog".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup "
    "modal overlay sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond reply replies footer "
    "masthead header topbar share sharing social related recommended newsletter subscribe signup login widget pagination pager skip toolbar "
    "contentinfo complementary search alert alertdialog menubar".split()
)
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_HINT = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Share of its parent's or article's characters that a core must hold to be widened to it.
PARENT_SHARE, ARTICLE_SHARE = 0.7, 0.5
#: Share of the text that must be under no name for names to count, where no article or heading tells.
FREE_SHARE = 0.2
#: Share of link characters from which a block inside the core that is below the threshold is left out.
LINK_SHARE = 0.6
#: Links up to which such a block at the very end of the article, unmarked, is one of references.
MANY_LINKS = 4
HIDDEN = "hidden"


class Page:
    """Nodes in document order, by parallel lists; the node 0 is the body. Texts hang on their parent node."""

    def __init__(self, source: str, names: bool = True):
        """Without ``names``, density is on its own."""
        self.tag, self.parent, self.mark = ["body"], [-1], [""]
        #: (node, text, number of the block that the text is in)
        self.texts: list[tuple[int, str, int]] = []
        self.block, self.names = 0, names
        #: Places on the stack of the open elements, by name; of blocks; of those that end a search for an open paragraph.
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self.scopes: list[int] = [0]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        match = _TAG.search(source)
        while match:
            if match.start() > at:
                self.texts.append((stack[-1], source[at : match.start()], self.block))
            at = match.end()
            close, name, attrs = match[1], match[2], match[3]
            if name is None:
                close, name, attrs = match[4], match[5], match[6]
            if name is not None:
                name = name.lower()
                if close:
                    self._end(stack, name)
                else:
                    self._start(stack, name, attrs)
                    if name in RAW and not attrs.endswith("/"):
                        found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                        at = found.start() if found else n
            match = _TAG.search(source, at)
        if at < n:
            self.texts.append((stack[-1], source[at:], self.block))

    def _close(self, stack: list[int], k: int) -> None:
        """End the element at place k of the stack and all below it."""
        if self.blocks[-1] >= k:
            self.block += 1
        for i in stack[k:]:
            self.open[self.tag[i]].pop()
        for places in (self.blocks, self.scopes):
            while places[-1] >= k:
                places.pop()
        del stack[k:]

    def _last(self, *names: str) -> int:
        """The place of the innermost open element of any name, 0 without one."""
        return max((places[-1] for n in names if (places := self.open.get(n))), default=0)

    def _start(self, stack: list[int], name: str, attrs: str) -> None:
        if name in ("html", "head", "body"):
            return
        if name in CLOSES_P and (k := self._last("p")) > self.scopes[-1]:
            self._close(stack, k)
        if name in ENDS:
            ends, stop = ENDS[name]
            if (k := self._last(*ends)) > self._last(*stop):
                self._close(stack, k)
        if name in BLOCK:
            self.block += 1
        elif name == "br":
            self.texts.append((stack[-1], " ", self.block))
        self.tag.append(name)
        self.parent.append(stack[-1])
        mark = "" if name in ("article", "main") else name if name in MARK_TAGS else _marked(attrs) if attrs else ""
        self.mark.append(mark)
        if name not in VOID:
            self.open.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                self.blocks.append(len(stack))
            if name in SCOPE:
                self.scopes.append(len(stack))
            stack.append(len(self.tag) - 1)

    def _end(self, stack: list[int], name: str) -> None:
        """End the innermost open element of that name; an inline one only within its block."""
        k = self._last(name)
        if k and (name in BLOCK or k > self.blocks[-1]):
            self._close(stack, k)

    def _kept(self) -> list[bool]:
        """Which nodes may hold prose: not those that are hidden or hold none, nor those below one."""
        keep = [True] * len(self.tag)
        for i in range(1, len(keep)):
            keep[i] = keep[self.parent[i]] and self.tag[i] not in NO_TEXT and self.mark[i] != HIDDEN
        return keep

    def _weighed(self, chars: list[int]) -> list[bool]:
        """Which nodes' own text counts as link text for the name of a node above; ``chars`` are those of each node alone."""
        n, tag, parent, mark = len(self.tag), self.tag, self.parent, self.mark
        if not self.names or not any(mark):
            return [False] * n
        holds, inside = [t in ("article", "main", "h1") for t in tag], [False] * n
        for i in range(n - 1, 0, -1):
            holds[parent[i]] |= holds[i]
        for i in range(1, n):
            inside[i] = inside[parent[i]] or tag[i] in ("article", "main")
        # a header inside an article or main element belongs to it, one outside is a header whatever it holds
        own = [m if m and ((tag[i] == "header" and not inside[i]) or not (holds[i] or tag[i] == "header")) else "" for i, m in enumerate(mark)]
        off: set[str] = set()
        while True:
            name = [""] * n
            for i in range(1, n):
                name[i] = name[parent[i]] or (own[i] if own[i] not in off else "")
            if any(holds[i] and chars[i] and not name[i] for i in range(n) if tag[i] in ("article", "main", "h1")):
                break
            by_name: dict[str, int] = {}
            for m, c in zip(name, chars, strict=True):
                by_name[m] = by_name.get(m, 0) + c
            free = by_name.pop("", 0)
            largest = max(by_name, key=lambda m: (by_name[m], m), default=None)
            if largest is None or free >= FREE_SHARE * (free + by_name[largest]):
                break
            off.add(largest)
        return [bool(m) for m in name]

    def text(self) -> str:
        n, tag, parent = len(self.tag), self.tag, self.parent
        keep = self._kept()
        chars, links = [0] * n, [0] * n
        texts = []
        for node, raw, block in self.texts:
            if keep[node]:
                t = html.unescape(raw) if "&" in raw else raw
                texts.append((node, t, block))
                chars[node] += sum(map(len, t.split()))
        weighed, own = self._weighed(chars), list(chars)
        links = [c if w else 0 for c, w in zip(chars, weighed, strict=True)]
        tags, link_tags = [0] * n, [0] * n
        for i in range(1, n):
            if keep[i]:
                tags[i] = 1
                link_tags[i] = 1 if tag[i] == "a" or weighed[i] else 0
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if tag[i] == "a":
                links[i] = chars[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            link_tags[p] += link_tags[i]
        if not chars[0]:
            return ""
        density, sums, filled = self._densities(chars, links, tags, link_tags)
        core, threshold = self._core(density, sums)
        # subtrees by their node of the largest sum, from the body down
        best = list(range(n))
        for i in range(n - 1, 0, -1):
            if sums[best[i]] > sums[best[parent[i]]]:
                best[parent[i]] = best[i]
        top = i = self._widen(core, [c - lc for c, lc in zip(chars, links, strict=True)])
        path = set()
        while i >= 0:
            path.add(i)
            i = parent[i]
        title = self._title(top, path, chars, links, weighed)
        trail = self._trail(top, own)
        covered = [False] * n
        for i in range(n):
            covered[i] = i in (top, title) or (i > 0 and covered[parent[i]])
            block = tag[i] in BLOCK and chars[i] and i not in path
            if covered[i] and block:
                many = weighed[i] or link_tags[i] > (MANY_LINKS if i in trail else 1)
                covered[i] = not (many and density[i] < threshold and links[i] >= LINK_SHARE * chars[i])
            elif block:
                covered[i] = density[i] >= threshold and filled[best[i]] > 1
        return self._render(texts, covered)

    def _densities(self, chars: list[int], links: list[int], tags: list[int], link_tags: list[int]) -> tuple[list[float], list[float], list[int]]:
        """Of every node the composite density, the sum of its children's, and how many of them have text."""
        n, parent = len(self.tag), self.parent
        share = links[0] / chars[0]
        density, sums, filled = [0.0] * n, [0.0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if chars[i]:
                density[i] = composite(chars[i], links[i], max(tags[i], 1), link_tags[i], share)
                if i:
                    sums[parent[i]] += density[i]
                    filled[parent[i]] += 1
        return density, sums, filled

    def _core(self, density: list[float], sums: list[float]) -> tuple[int, float]:
        """The node of the largest density sum, and the least density from it up to the body."""
        core = i = max(range(len(sums)), key=lambda i: (sums[i], -i))
        threshold = density[core]
        while i > 0:
            i = self.parent[i]
            threshold = min(threshold, density[i])
        return core, threshold

    def _widen(self, core: int, chars: list[int]) -> int:
        """The article, main element or parent that holds little else than the core, by characters that are no links."""
        i = core
        while i > 0:
            if self.tag[i] in ("article", "main") and chars[core] >= ARTICLE_SHARE * chars[i]:
                return i
            i = self.parent[i]
        while self.parent[core] > 0 and chars[core] >= PARENT_SHARE * chars[self.parent[core]]:
            core = self.parent[core]
        return core

    def _trail(self, top: int, own: list[int]) -> set[int]:
        """The nodes below the article that its last text is in; ``own`` are the characters of each node alone."""
        inside, last = [False] * len(own), -1
        inside[top] = True
        for i in range(top + 1, len(own)):
            inside[i] = inside[self.parent[i]]
            if inside[i] and own[i]:
                last = i
        found = set()
        while last > top:
            found.add(last)
            last = self.parent[last]
        return found

    def _title(self, top: int, path: set[int], chars: list[int], links: list[int], weighed: list[bool]) -> int:
        """The block of the last first-level heading before the article, if that has none, and no name or links say that the block is something else; else -1."""
        tag, parent = self.tag, self.parent
        found = -1
        for i in range(1, len(tag)):
            if tag[i] == "h1" and chars[i] and not weighed[i]:
                if i < top:
                    found = i
                else:
                    at = i
                    while at > top:
                        at = parent[at]
                    # nodes come in document order, so one below the article leads up to it
                    if at == top:
                        return -1
        if found < 0:
            return -1
        marked = bool(self.names and self.mark[found])
        while parent[found] not in path:
            found = parent[found]
            marked |= bool(self.names and self.mark[found])
        return -1 if marked or links[found] >= LINK_SHARE * chars[found] else found

    @staticmethod
    def _render(texts: list[tuple[int, str, int]], covered: list[bool]) -> str:
        """The covered texts, those of one block joined."""
        blocks: dict[int, list[str]] = {}
        for node, t, block in texts:
            if covered[node]:
                blocks.setdefault(block, []).append(t)
        lines = (_SPACE.sub(" ", "".join(x)).strip() for x in blocks.values())
        return "\n".join(x for x in lines if x)


def composite(chars: int, links: int, tags: int, link_tags: int, body_share: float) -> float:
    """Characters per tag, adjusted by the share of links; ``body_share`` is the link share of the whole body."""
    base = math.log(chars / max(chars - links, 1) * links + body_share * chars + math.e)
    adjusted = chars / max(links, 1) * (tags / max(link_tags, 1))
    return chars / tags * max(math.log(max(adjusted, 1.0)) / math.log(max(base, math.e)), 0.0)


def _marked(attrs: str) -> str:
    """The first name in a start tag's attributes that marks its text, HIDDEN if it is not shown, or nothing."""
    found = ""
    for name, a, b, c in _HINT.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return HIDDEN
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return HIDDEN
        elif name != "aria-hidden" and not found:
            found = next((w for w in _WORD.findall(value) if w in MARKS), "")
    return found


def main_text(source: str | None, names: bool = True) -> str:
    """The article of one page."""
    return Page(source, names).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
