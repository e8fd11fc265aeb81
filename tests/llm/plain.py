"""Plain versions of the corpus operators, for small inputs, and awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

LAST = (1 << 63) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CLASHES = ("id", "doc", "size", "row", "n", "version", "score", "spans", "kept", "digest", "first", "key", "bin", "taken", "target", "words", "component_id", "host", "path", "p", "i", "v", "lower", "spoken", "payload", "refers_to", "rank", "dim", "cell", "block")


def clashing(frame):
    """The same rows with further columns named as the operators' own."""
    return frame.withColumns({c: F.lit("clash") for c in CLASHES if c not in frame.columns})


def repeats(rows, length=50):
    first: dict[bytes, int] = {}
    for doc, text in rows:
        data, doc = (text or "").encode(), LAST if doc is None else doc
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            first[window] = min(first.get(window, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (LAST if doc is None else doc):
                mask[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(data)) if mask[i] and (not i or not mask[i - 1]))
        out.append((doc, len(data), sum(mask), spans, hashlib.sha256(bytes(c for c, gone in zip(data, mask, strict=True) if not gone)).hexdigest()))
    return out


def components(rows, k=3, num=90, den=100):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set()))
    holders: dict[tuple, list[int]] = {}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        for j, both in Counter(j for x in own for j in holders.get(x, ())).items():
            if den * both >= num * (len(own) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for x in own:
            holders.setdefault(x, []).append(i)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), doc) if x is not None), default=None)
    return [(doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def top(rows, k=20, every=20, scale=64):
    fit = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for query, q in fit:
        if query is not None and query % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), LAST if i is None else i) for i, v in fit if i != query and len(v) == len(q))[:k]
            out += [(query, n + 1, None if i == LAST else i, -s) for n, (s, i) in enumerate(best)]
    return out


BLANK, MARKS, FULL = " \t\n\v\f\r", ".!?", "。！？"


def units(text):
    """(start, end) of sentences."""
    out, start, i = [], 0, 0
    while i < len(text):
        while i < len(text) and text[i] != "\n" and text[i] not in FULL:
            if text[i] in MARKS:
                k = i
                while k < len(text) and text[k] in MARKS:
                    k += 1
                if k == len(text) or text[k] in BLANK or text[k] in FULL:
                    break
                i = k
            i += 1
        while i < len(text) and text[i] in MARKS + FULL:
            i += 1
        while i < len(text) and text[i] in BLANK:
            i += 1
        out.append((start, i))
        start = i
    return out


def lines(rows, least=24):
    """(doc, kept text, number of spans taken out) of documents with different ids."""
    seen, out = set(), {}

    def key_of(unit):
        key = " ".join(unit.translate(str.maketrans(BLANK, " " * 6)).split(" ")).strip(" ").lower()
        while "  " in key:
            key = key.replace("  ", " ")
        return key

    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        text, rows_ = text or "", [[]]
        for a, b in units(text):
            if key_of(text[a:b]):
                rows_[-1].append((a, b))
            if "\n" in text[a:b]:
                rows_.append([])
        gone = []
        for own in rows_:
            for a, b in ([(own[0][0], own[-1][1])] if len(own) > 1 else []) + own:
                key = key_of(text[a:b])
                if len(key.encode()) < least:
                    continue
                if key in seen:
                    if a and text[a - 1] != "\n":
                        feed = text.find("\n", a + len(text[a:b].rstrip(BLANK)), b)
                        b = b if feed < 0 else feed
                    gone.append((a, b))
                seen.add(key)
        gone = [g for g in gone if not any(h != g and h[0] <= g[0] and g[1] <= h[1] for h in gone)]
        at, kept = 0, ""
        for a, b in sorted(gone):
            kept, at = kept + text[at:a], b
        out[doc] = (kept + text[at:], len(gone))
    return out


def nearest(pattern, text):
    """The least number of edits between a pattern and any stretch of a text, by the full table."""
    at = np.arange(len(text) + 1)
    text, row = np.array(text), np.zeros(len(text) + 1, np.int64)
    for n, x in enumerate(pattern, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (text != x)) if len(text) else row[1:]
        row = np.minimum.accumulate(np.append(n, best) - at) + at
    return int(row.min())


def leaks(items, rows, rate=0.2):
    """Pairs (document, item) of which the item is held with at most `rate` of its words, or of its characters, edited."""
    low = lambda t: [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]
    number = {}
    out = set()
    for doc, t in rows:
        words = low(t)
        letters = list(b" ".join(words))
        for item, own in ((i, low(x)) for i, x in items):
            name = lambda ws: [number.setdefault(w, len(number)) for w in ws]
            if own and (nearest(name(own), name(words)) <= int(rate * len(own)) or nearest(list(b" ".join(own)), letters) <= int(rate * len(b" ".join(own)))):
                out.add((doc, item))
    return out


class Article(HTMLParser):
    """The blocks of a page's article element, read with the standard parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.depth = [], "", 0
        self.feed(page)
        self.close()

    def cut(self):
        if self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1", "div", "ul", "li"):
            self.cut()
        self.depth += tag == "article"
        self.text += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "div", "ul", "li"):
            self.cut() if self.depth else None
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.text += data if self.depth else ""


def article(page):
    return "\n\n".join(Article(page or "").blocks)
