"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 3
SURGE = 86

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|textarea|noscript|template|svg|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text, and words of class, id and role that mark such elements.
CERTAIN = frozenset("nav footer aside menu select button head object audio video canvas map".split())
APART = CERTAIN | {"form", "dialog"}
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies contentinfo disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signin signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Blocks:
    """Text blocks of a page in order: text, length without link text, whether it stands apart, whether in an article."""

    def __init__(self, page: str) -> None:
        self.found: list[tuple[str, int, bool, bool]] = []
        self.titles: set[int] = set()
        self.title = False
        self.text: list[str] = []
        self.linked = self.links = self.inside = 0
        tags = [m for m in TOKEN.finditer(page)]
        skip_to = self.apart(tags, page)
        at, until = 0, -1
        for i, m in enumerate(tags):
            if m.start() > at:
                self.add(page[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if i >= until > -1:
                self.close(True)
                until = -1
            if i in skip_to and until < 0:
                self.close(False)
                until = skip_to[i]
            if name in BLOCKS:
                self.close(until > -1)
                self.title = name == "h1" and not m["end"]
                self.inside = max(0, self.inside + (-1 if m["end"] else 1)) if name in ("article", "main") else self.inside
                if name not in ("li", "p"):
                    self.links = 0
            elif name == "br":
                self.text.append(" ")
            elif name == "a":
                self.links = 0 if m["end"] else 1
        self.add(page[at:])
        self.close(until > -1)

    def add(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.text.append(text)
        if self.links:
            self.linked += len(text.strip())

    def close(self, apart: bool) -> None:
        if self.text:
            block = " ".join("".join(self.text).split())
            if block:
                if self.title:
                    self.titles.add(len(self.found))
                self.found.append((block, max(0, len(block) - self.linked), apart, self.inside > 0))
            self.text = []
        self.linked = 0

    @staticmethod
    def apart(tags: list[re.Match], page: str) -> dict[int, int]:
        """Of tags that open an element apart from the main text, the tag that closes it; all by index.

        A mark in class, id or role, and a form, dialog or header, count if the text elsewhere is more than the element's own;
        where a whole word of class, id or role is the mark, a quarter of that is enough, and so is an unmarked article
        elsewhere. If the element holds an article, the text elsewhere has to be enough for a surge, too.
        """
        out: dict[int, int] = {}
        ends, open_, articles = {}, {}, []
        for i, m in enumerate(tags):
            name = (m["name"] or "").lower()
            if not name or name in VOID:
                continue
            if name in ("article", "main") and not m["end"]:
                articles.append(i)
            if not m["end"]:
                open_.setdefault(name, []).append(i)
            elif open_.get(name):
                ends[open_[name].pop()] = i
        doubtful: dict[int, tuple[int, bool, bool]] = {}
        until = depth = 0
        for i, m in enumerate(tags):
            name = (m["name"] or "").lower()
            if not name or name in VOID or i < until:
                continue
            if name in ("article", "main"):
                depth = max(0, depth + (-1 if m["end"] else 1))
            if m["end"] or name in ("html", "body", "h1", "p"):
                continue
            attrs = m["attrs"] or ""
            whole = {w for x in ATTRIBUTE.findall(attrs) for w in "".join(x).lower().split()} if "=" in attrs else set()
            words = {w for x in whole for w in re.split(r"[_-]+", x)}
            hidden = bool(attrs and HIDDEN.search(attrs))
            marked = hidden or bool(words & MARKS)
            if not (name in APART or name == "header" and not depth or marked):
                continue
            end, at = ends.get(i), bisect(articles, i)
            holds = at < len(articles) and (end is None or articles[at] < end)
            if holds and name in ("nav", "footer", "header", "head"):
                end = articles[at]  # never closed: it ends where the article begins
            if end is not None and name not in CERTAIN:
                doubtful[i] = end, hidden or bool(whole & MARKS) or not marked, holds or name in ("article", "main")
                continue
            if name not in APART and (holds or end is None) or end is None and holds:
                continue  # it holds the article, or nothing tells where it ends
            out[i] = until = len(tags) if end is None else end
        return Blocks.settled(tags, page, out, ends, doubtful) if doubtful else out

    @staticmethod
    def settled(tags: list[re.Match], page: str, out: dict[int, int], ends: dict[int, int], doubtful: dict[int, tuple[int, bool, bool]]) -> dict[int, int]:
        """Adds to `out` those of the doubtful elements that the rest of the page shows to be apart."""
        own, inner, article = {-1: 0}, dict.fromkeys(doubtful, 0), {-1: 0}
        path, until, links, at, clear = [-1], -1, 0, 0, []
        for i, m in enumerate(tags):
            if until < 0 and not links:
                n = len(page[at : m.start()].strip())
                own[path[-1]] += n
                for x in path[1:]:
                    inner[x] += n
                if any(depth == len(path) for _, depth in clear):
                    article[path[-1]] += n
            at = m.end()
            name = (m["name"] or "").lower()
            if i >= until:
                until = out.get(i, -1)
            while len(path) > 1 and i >= doubtful[path[-1]][0]:
                path.pop()
            clear = [x for x in clear if i < x[0]]
            if i in doubtful:
                path.append(i)
                own[i] = article[i] = 0
            if name in ("article", "main") and i in ends and not doubtful.get(i, (0, False, False))[1]:
                clear.append((ends[i], len(path)))
            if name == "a":
                links = 0 if m["end"] else 1
            elif name in BLOCKS and name not in ("li", "p"):
                links = 0
        if until < 0 and not links:
            own[-1] += len(page[at:].strip())
        open_: list[int] = []
        around: dict[int, list[int]] = {}
        clear_own, clear_article = dict(own), dict(article)  # by whole words alone: text under other marks is that of what holds it
        for i, (_, exact, _) in doubtful.items():
            while open_ and i >= doubtful[open_[-1]][0]:
                open_.pop()
            around[i] = [-1, *open_]
            if not exact:
                holder = next((x for x in reversed(open_) if doubtful[x][1]), -1)
                clear_own[holder] += clear_own.pop(i)
                clear_article[holder] += clear_article.pop(i)
            open_.append(i)
        for i, (end, exact, holds) in doubtful.items():
            if any(x in out for x in around[i][1:]):
                continue
            rest = sum((clear_own if exact else own).get(x, 0) for x in around[i])
            if (rest >= SURGE or not holds) and (rest > inner[i] or exact and (rest * 4 >= inner[i] or sum(clear_article.get(x, 0) for x in around[i]) >= SURGE)):
                out[i] = end
        return out


def text_runs(weights: list[int]) -> list[tuple[int, int]]:
    """(first block, block after the last) of all stretches from a surge of the window sums to the next dive."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    surge = min(SURGE, max(sums, default=0) / 2)
    runs: list[tuple[int, int]] = []
    i = 0
    while i < len(weights):
        if not weights[i] or sums[i] <= surge:
            i += 1
            continue
        j = i
        while j < len(weights) and (weights[j] or sums[j] > surge):
            j += 1  # the dive: no text in this block and little in the next ones
        runs.append((i, j))
        i = j
    return runs


def kept(blocks: list[tuple[str, int, bool, bool]], titles: set[int] = frozenset()) -> list[str]:
    """The blocks between the surge and the dive of text length over sliding windows of blocks.

    A block weighs its text that is no link, or nothing if that is the smaller part or the block stands apart. Where the
    articles of a page hold as much text as the longest stretch outside them, or none outside would surge, their blocks
    weigh a surge more each and other blocks nothing, so surge and dive fall on an article's edges, however short its
    text; a title (h1) right before an article weighs as its blocks do. All but blocks apart is kept between surge and dive.
    """
    weights = [0 if apart or n * 2 < len(text) else n for text, n, apart, _ in blocks]
    if any(inside and not apart for _, _, apart, inside in blocks):
        outside = [0 if inside else w for w, (*_, inside) in zip(weights, blocks, strict=True)]
        longest = max((sum(outside[i:j]) for i, j in text_runs(outside)), default=0)
        if longest <= max(SURGE, sum(len(text) for text, _, apart, inside in blocks if inside and not apart)):
            near = {k for k in titles if not blocks[k][2] and next((b[3] for b in blocks[k + 1 :] if not b[2]), False)}
            blocks = [(text, n, apart, inside or k in near) for k, (text, n, apart, inside) in enumerate(blocks)]
            blocks = [b for b in blocks if not (b[2] and b[3])]  # what stands apart within an article does not part it
            weights = [len(text) + SURGE if inside else 0 for text, _, _, inside in blocks]
            return [blocks[k][0] for i, j in text_runs(weights) for k in range(i, j) if weights[k]]
    return [blocks[k][0] for i, j in text_runs(weights) for k in range(i, j) if not blocks[k][2]]


def extract(page: str | None) -> str:
    """The main text of one page; empty if there is none."""
    if not page:
        return ""
    blocks = Blocks(page)
    return "\n\n".join(kept(blocks.found, blocks.titles))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Extracts the main text of pages: id, url, text, n_chars.

    Markup is stripped into blocks, the lengths of block texts without links are summed over windows of three blocks,
    and the blocks between points where the sums surge and points where they dive are kept. Elements that HTML or their
    class, id or role mark as menu, header, footer, sidebar, notice, advert, form or comments weigh nothing and are left
    out, unless what is elsewhere on the page is little beside them. Blocks of an article or main element weigh more,
    unless a longer stretch of text is outside. Character
    references are decoded, white space within a block becomes one space, blocks are joined by a blank line in page
    order. A null or empty page gives an empty text; repeated rows and extra columns make no difference. Each page is
    worked on alone, so nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(id_col, url_col, html_col).mapInArrow(work, schema)
