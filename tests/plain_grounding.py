"""Grounding of one document after the other, window by window; reads prepared tokens and candidates, and nothing else of the library."""

import math
import re

from docledger.functions import text
from docledger.operators.grounding import LABELS, MONEY_TOKEN, ORDER
from tests.test_functions import plain_date, plain_number, plain_osa


def shaped(s):
    amount = any(m in s for m in text.MARKS) or re.search(r"\d[.,']\d", s) or re.search(r"[.,]\d{2}\D*\Z", s)
    return bool(re.search(r"\d", s)) and "%" not in s and bool(amount)


def admitted(token, c):
    first = lambda s: s.split(" ")[0]
    return (
        token.text == first(c.raw)
        or (c.norm != "" and token.norm != "" and first(token.norm) == first(c.norm))
        or ((c.amount is not None or c.day is not None) and bool(re.search(r"\d", token.text)))
        or (c.day is not None and token.month)
        or (len(c.key) >= 3 and token.key != "" and token.key[0] == c.key[0])
    )


def score(own, c):
    raw, norm, key = " ".join(t.text for t in own), " ".join(t.norm for t in own if t.norm), "".join(t.key for t in own)
    if raw == c.raw:
        return 1.0, "exact"
    if c.norm and norm == c.norm:
        return 0.9, "normalized"
    if c.amount is not None and len(own) <= 3 and all(re.match(MONEY_TOKEN, t.text) for t in own) and shaped(raw) and plain_number(raw, 2) == c.amount:
        return 0.9, "normalized"
    if c.day is not None and len(own) <= 4 and plain_date(raw) == c.day:
        return 0.9, "normalized"
    if len(c.key) >= 3 and abs(len(key) - len(c.key)) <= max(2, len(c.key) // 4):
        similar = 1 - plain_osa(key, c.key) / max(len(key), len(c.key))
        if similar >= 0.85:
            return similar * 0.8, "fuzzy"
    return None


def rounded(x):
    return math.floor(x * 10000 + 0.5) / 10000


def centre(own):
    x, y = rounded(min(t.x for t in own)), rounded(min(t.y for t in own))
    right, bottom = rounded(max(t.x + t.w for t in own)), rounded(max(t.y + t.h for t in own))
    return x + rounded(right - x) / 2, y + rounded(bottom - y) / 2


def label_centres(tokens, field):
    out = []
    for label in LABELS.get(field, ()):
        words = re.sub(r"[\W_]+", " ", label.lower()).strip().split()
        for i in range(len(tokens) - len(words) + 1):
            if words and " ".join(t.norm for t in tokens[i : i + len(words)]) == " ".join(words):
                out.append(centre(tokens[i : i + len(words)]))
    return out


def place(pages, wanted, field, page, taken, near=None, side=0):
    """The best place of a value: (page, start, end, score, method, line, x), or None."""
    best = None
    for number, tokens in pages:
        labels = label_centres(tokens, field)
        for c in wanted:
            for start in range(len(tokens)):
                if not admitted(tokens[start], c):
                    continue
                for end in range(start + 1, min(len(tokens), start + min(12, c.words + 2)) + 1):
                    if any(number == p and start < b and end > a for p, a, b in taken):
                        continue
                    own = tokens[start:end]
                    found = score(own, c)
                    if not found:
                        continue
                    x, y = centre(own)
                    label = min((abs(b - y) * 3 + abs(a - x) for a, b in labels), default=math.inf)
                    here = near is not None and near[0] == number
                    far = abs(own[0].line - near[1]) if here else math.inf
                    after = near is not None and near[2] is not None and not (here and start >= near[2])
                    rank = (-found[0], number != page, end - start, far, after, label, side * own[0].x, number, start, c.ordinal)
                    if best is None or rank < best[0]:
                        best = rank, (number, start, end, *found, own[0].line)
    return best and best[1]


def ground(pages, candidates, preferred):
    """(field_path) -> place, of one document: pages (number, tokens), candidates by field, and the pages that values were read from."""
    out = {}
    taken = []
    for field in ORDER:
        if field in candidates and (found := place(pages, candidates[field], field, preferred[field], taken)):
            out[field] = found
            taken.append(found[:3])
    used = []
    for row in sorted({int(f.split(".")[1]) for f in candidates if f.startswith("lineItems.")}):
        path = f"lineItems.{row}.description"
        text_ = place(pages, candidates[path], None, preferred[path], used) if path in candidates else None
        own, near = [], None
        if text_:
            out[path] = text_
            used.append(text_[:3])
            own, near = [text_[:3]], (text_[0], text_[5], text_[2])
        for cell in ("quantity", "unitPrice", "amount") if text_ else ("amount", "unitPrice", "quantity"):
            path = f"lineItems.{row}.{cell}"
            if path not in candidates or (cell == "quantity" and near is None):
                continue
            page = preferred[path] if preferred[path] is not None else near and near[0]
            if found := place(pages, candidates[path], None, page, own, near, -1 if cell == "amount" else 1):
                out[path] = found
                own.append(found[:3])
                near = near or (found[0], found[5], None)
    return out
