"""Finds benchmark items in documents, small edits allowed: CGK embedding by characters, bit sampling, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm._spark import byte_blocks
from docledger.llm.jaccard import BLOCK, LOWER, Words
from docledger.llm.suffix import mixed

RATE = 0.2
#: How likely two stretches of an item stay whole; measured recall is higher (0.98 at a fifth of the characters), as walks fall into step again after edits.
WHOLE = 0.6
SEED = 8
LEAST_REACH, MOST_REACH = 6, 14
GRAM = 4
#: How far alignments of neighbouring stretches lie apart, by inserted and left out characters.
SLACK = 4
FILTER = 20
CHUNK = 1 << 15
SLICE_BYTES = 32 << 20
FOLD = np.uint64(0x9E3779B97F4A7C15)
#: Thai and Lao, Burmese, Khmer, Chinese and Japanese, compatibility and full-width forms; Chinese beyond U+20000 comes with them.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def reach(size: int, rate: float, whole: float) -> int:
    """Over how many characters a walk may go, so that two walks of an item of this size meet no edit with this probability.

    Edits at this rate leave about rate * size + 1 stretches, each of so many characters with a probability of
    (1 - rate) to that power; two stretches have to be that long.
    """
    if rate <= 0:
        return MOST_REACH
    stretches = rate * size + 1
    for n in range(MOST_REACH, LEAST_REACH, -1):
        long = (1 - rate) ** n
        if (1 - long) ** stretches + stretches * long * (1 - long) ** (stretches - 1) <= 1 - whole:
            return n
    return LEAST_REACH


class Seeds:
    """Stretches of which any allowed edits of an item leave at least one as it was.

    An item that may have k words edited is cut into k + 1 stretches, and an edit touches at most one of them; up to 8
    words of each are looked for. So items of any length are found for certain, also where walks meet an edit at once.
    """

    def __init__(self, items: list[tuple[int, np.ndarray, bytes]], rate: float) -> None:
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for n, (_, words, _) in enumerate(items):
            parts = min(len(words), int(rate * len(words)) + 1)
            cuts = [len(words) * i // parts for i in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                size = min(SEED, b - a)
                by_size.setdefault(size, []).append((int(self.keys(words[a : a + size], size)[0]), n, a))
        self.tables = []
        for size, rows in by_size.items():
            keys, members, begins = zip(*sorted(rows), strict=True)
            table, filter_ = np.array(keys, np.uint64), np.zeros(1 << FILTER, bool)
            filter_[(table >> np.uint64(64 - FILTER)).astype(np.int64)] = True
            self.tables.append((size, filter_, table, members, begins))

    @staticmethod
    def keys(words: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all stretches of so many words."""
        key = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for t in range(size):
            key = key * FOLD + words[t : t + len(key)]
        return mixed(key * FOLD)

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(word at which the item would begin, item) wherever one of an item's stretches stands."""
        found = []
        for size, filter_, table, members, begins in self.tables:
            keys = self.keys(words, size)
            at = np.flatnonzero(filter_[(keys >> np.uint64(64 - FILTER)).astype(np.int64)])
            lo, hi = np.searchsorted(table, keys[at]), np.searchsorted(table, keys[at], side="right")
            for i in np.flatnonzero(hi > lo):
                for j in range(lo[i], hi[i]):
                    found.append((int(at[i]) - begins[j], members[j]))
        return found


class Sketch:
    """Bit samples of the CGK embeddings of items, read as characters: words in lower case with single spaces.

    The embedding writes the character it stands on at each step of a walk, and moves on if a random bit of (step,
    character) says so; after an edit two walks fall into step again, so that edits become differences at single steps.
    A sample is the steps of a walk but for a random quarter. An item's window is walked from each of its characters and
    so is the document; each begin is a repetition with places of its own. An item is a candidate where two walks that
    begin at different places agree, in samples of one alignment. How far walks go follows from the item's size, the rate
    of edits and the share of items of which two stretches are to stay whole.
    """

    def __init__(self, items: list[tuple[int, np.ndarray, bytes]], rate: float, whole: float, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.items, self.rate, self.seeds = items, rate, Seeds(items, rate)
        self.symbols = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.steps = 2 * MOST_REACH
        self.sampled = np.ones(self.steps, bool)
        self.sampled[1 + rng.permutation(self.steps - 1)[: self.steps // 4]] = False
        by_reach: dict[int, list[int]] = {}
        for n, (_, _, letters) in enumerate(items):
            by_reach.setdefault(reach(len(letters), rate, whole), []).append(n)
        self.ends: dict[int, tuple] = {}
        self.filters: dict[int, np.ndarray] = {}
        for far, members in by_reach.items():
            texts = [np.frombuffer(items[n][2], np.uint8) for n in members]
            data, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
            left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
            keys, item, begin = [], [], []
            for at, key, stop in self.walks(data, 2 * far):
                whole = stop < left[at]  # a walk stays in its item
                keys.append(key[whole])
                of = np.searchsorted(offsets, at[whole], side="right") - 1
                item.append(np.array(members)[of])
                begin.append(at[whole] - offsets[of])
            table, item, begin = np.concatenate(keys), np.concatenate(item), np.concatenate(begin)
            order = np.argsort(table, kind="stable")
            self.ends[2 * far] = table[order], item[order], begin[order]
            for step in (LEAST_REACH + 2, 2 * LEAST_REACH - 1):  # of all walks, those that go on after so many steps
                passed = self.filters.setdefault(step, np.zeros(1 << FILTER, bool))
                for _, key, _ in self.walks(data, step):
                    passed[self.slot(key)] = True
        for end, (table, _, _) in self.ends.items():
            self.filters[end] = np.zeros(1 << FILTER, bool)
            self.filters[end][self.slot(table)] = True
        self.grams: dict[int, np.ndarray] = {}

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - FILTER)).astype(np.int64)

    def walks(self, data: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(begins, keys, places reached, relative to the begin) of walks of so many steps from all characters."""
        for _, begin, key, at in self.walked(data, {steps}, {}):
            yield begin, key, at - begin

    def walked(self, data: np.ndarray, ends: set[int], filters: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(steps, begins, keys, places) of all walks after the numbers of steps in `ends`; those that a filter knows nothing of are given up."""
        last = max(ends)
        for start in range(0, len(data), CHUNK):
            symbols = self.symbols[data[start : start + CHUNK + last]]
            symbols = np.concatenate([symbols, np.zeros(last + 1, np.uint64)])
            begin = at = np.arange(min(CHUNK, len(data) - start))
            key = np.zeros(len(at), np.uint64)
            for step in range(last):
                symbol = symbols[at]
                if self.sampled[step]:
                    key = key * FOLD + symbol
                at = at + ((symbol >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
                if step + 1 in ends:
                    known = np.flatnonzero(filters[step + 1][self.slot(key)]) if step + 1 in filters else slice(None)
                    yield step + 1, start + begin[known], key[known], start + at[known]
                elif step + 1 in filters:
                    known = np.flatnonzero(filters[step + 1][self.slot(key)])
                    begin, key, at = begin[known], key[known], at[known]

    def candidates(self, data: np.ndarray) -> np.ndarray:
        """Rows (character at which the item would begin, item), one for each alignment in which two walks agree."""
        found = []
        for end, begin, key, _ in self.walked(data, set(self.ends), self.filters) if self.ends else ():
            table, item, own = self.ends[end]
            lo, hi = np.searchsorted(table, key), np.searchsorted(table, key, side="right")
            count = hi - lo
            row = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            found.append(np.stack([item[row], np.repeat(begin, count) - own[row], own[row]], axis=1))
        if not found:
            return np.zeros((0, 2), np.int64)
        hits = np.concatenate(found)
        hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
        new = np.flatnonzero((np.diff(hits[:, 0], prepend=-1) != 0) | (np.diff(hits[:, 1], prepend=0) > SLACK))
        if not len(new):
            return np.zeros((0, 2), np.int64)
        several = np.maximum.reduceat(hits[:, 2], new) - np.minimum.reduceat(hits[:, 2], new) >= LEAST_REACH
        ends = np.append(new[1:], len(hits))
        middle = hits[(new + ends - 1) // 2][several]
        width = (hits[ends - 1, 1] - hits[new, 1])[several]
        return np.stack([middle[:, 1], middle[:, 0], width], axis=1)

    def may_hold(self, item: int, region: np.ndarray) -> bool:
        """Whether enough of an item's 4-grams are there: an edit takes away four at most."""
        letters = self.items[item][2]
        need = len(letters) - GRAM + 1 - GRAM * int(self.rate * len(letters))
        if need <= 0:
            return True
        if item not in self.grams:
            self.grams[item] = np.zeros(1 << 16, bool)
            self.grams[item][four(np.frombuffer(letters, np.uint8))] = True
        seen = np.cumsum(self.grams[item][four(region)], dtype=np.int32)
        span = len(letters) + int(self.rate * len(letters)) - GRAM + 1  # no stretch within the edits allowed has more
        if len(seen) > span:
            seen[span:] = (seen[span:] - seen[:-span]).copy()
        return int(seen.max(initial=0)) >= need


def four(data: np.ndarray) -> np.ndarray:
    """The 4-grams of bytes, hashed to 16 bits."""
    x = data.astype(np.uint32)
    return ((x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def edits(pattern: list[int], text: list[int]) -> list[int]:
    """Of each place of a text the least number of word edits between the pattern and a stretch that ends there (Myers' bit vectors)."""
    n = len(pattern)
    masks: dict[int, int] = {}
    for i, x in enumerate(pattern):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, out = full, 0, n, []
    for x in text:
        eq = masks.get(x, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts in lower case, each with a space behind it, and the places where they begin."""
    sizes = ends - starts + 1
    begins = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) + np.repeat(starts - begins, sizes)
    out = LOWER[data[np.minimum(place, len(data) - 1)]]
    out[begins + sizes - 1] = 32
    return out, begins


def located(pattern: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(begin, end, edits) of the stretch of a text nearest to a pattern, if it is near enough."""
    ends = edits(pattern, text)
    least = min(ends, default=most + 1)
    if least > most:
        return None
    end = ends.index(least) + 1
    return end - 1 - edits(pattern[::-1], text[:end][::-1]).index(least), end, least


def matches(sketch: Sketch, words: np.ndarray, begin: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int, str]]:
    """(text, item, first word, word after the last, edits, their unit) of items in texts, each verified exactly, by words and else by characters."""
    best: dict[tuple[int, int], list] = {}
    of = lambda word: int(np.searchsorted(begin, word, side="right")) - 1
    for start, item in sorted(set(sketch.seeds.candidates(words))):
        _, pattern, _ = sketch.items[item]
        n = len(pattern)
        most = int(sketch.rate * n)
        text = of(min(max(start, 0) + n // 2, len(words) - 1))
        lo, hi = max(int(begin[text]), start - most - 1), min(int(begin[text + 1]), start + n + most + 1)
        spans = best.setdefault((text, item), [])
        if any(a <= start < b for a, b, *_ in spans):
            continue
        region, own = words[lo:hi].tolist(), pattern.tolist()
        # an edit takes away one of an item's different words at most
        if len(set(own) & set(region)) >= len(set(own)) - most and (hit := located(own, region, most)):
            spans.append((lo + hit[0], lo + hit[1], hit[2], "word"))
    letters, at = spelled(data, starts, ends)
    bounds = np.append(at, len(letters))[begin]  # where texts begin
    for start, item, width in sketch.candidates(letters).tolist():
        own = sketch.items[item][2]
        n, most = len(own), int(sketch.rate * len(own))
        text = int(np.searchsorted(bounds, min(max(start, 0) + n // 2, len(letters) - 1), side="right")) - 1
        lo, hi = max(int(bounds[text]), start - most - width), min(int(bounds[text + 1]), start + n + most + width)
        spans = best.setdefault((text, item), [])
        word = int(np.searchsorted(at, max(start, 0) + n // 2, side="right")) - 1
        if any(a <= word < b for a, b, *_ in spans) or not sketch.may_hold(item, letters[lo:hi]):
            continue
        if hit := located(list(own), letters[lo:hi].tolist(), most):
            first, last = (int(np.searchsorted(at, lo + x, side="right")) - 1 for x in (hit[0], max(hit[0], hit[1] - 1)))
            spans.append((first, last + 1, hit[2], "character"))
    for (text, item), spans in best.items():
        for span in spans:
            yield text, item, *span


class AlnumWords(Words):
    """Words are runs of ASCII letters and digits and of other than ASCII characters; in scripts without spaces each character is one."""

    breaks = BREAK

    def cuts(self, data: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(data >= 0xE0)
        if not len(at):
            return at
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        code = (padded[at] & 15) << 12 | (padded[at + 1] & 63) << 6 | padded[at + 2] & 63
        three = (padded[at] < 0xF0) & np.any([(a <= code) & (code <= b) for a, b in UNSPACED], axis=0)
        four = (padded[at] == 0xF0) & (padded[at + 1] >= 0xA0)
        return np.concatenate([at[three], at[three] + 3, at[four], at[four] + 4])


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, whole: float = WHOLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Where documents hold items with at most `rate` of the item's words edited, or else of its characters: id, item, start, end, edits, unit, item_words.

    Edits are words (or characters, as `unit` says) inserted, left out or replaced; words are runs of letters and digits, case folded for A-Z,
    so punctuation and white space don't count; in scripts without spaces each character is a word. Start and end are
    characters of the text. Items of which at most so many words are edited are all found, by stretches of words that
    the edits leave whole. Those that only agree by characters are found by samples of CGK walks: 0.9 and more of items
    of some 90 characters or longer, measured up to the full rate; whatever is returned is verified by exact edit distance. Items of fewer
    than 5 words (at the default rate) are looked for as they are. Items without any letter or digit are not searched for.

    Items are searched for in slices of at most 32 MiB of their text, as they travel to all tasks; documents are only
    scanned, nothing is shuffled. Null or empty texts hold nothing. Repeated rows give repeated answers, items with equal
    texts one each. Extra columns are not read.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, ceil(size / (SLICE_BYTES / 2)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("item", items.schema["item"].dataType), *T._parse_datatype_string("start long, end long, edits int, unit string, item_words int").fields])
    out = None
    for part in range(slices):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == part).orderBy("item", "text").collect()
        words = AlnumWords(1)
        known = []
        for row in rows:
            data = np.frombuffer(row.text.encode(), np.uint8)
            own, starts, ends, _ = words.hashes(data, np.array([0, len(data)]))
            if len(own):
                known.append((row.item, own, spelled(data, starts, ends)[0][:-1].tobytes()))
        sent = spark.sparkContext.broadcast(known)

        def scan(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            words, sketch = AlnumWords(1), Sketch(sent.value, rate, whole)
            for part, data, offsets in byte_blocks(batches, "text", BLOCK):
                if not sketch.items:
                    continue
                own, starts, ends, begin = words.hashes(data, offsets)
                if not len(own):
                    continue
                rows = []
                for text, item, a, b, e, unit in matches(sketch, own, begin, data, starts, ends):
                    place = offsets[text]
                    chars = lambda to: int(((data[place:to] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                    rows.append((text, sketch.items[item][0], chars(starts[a]), chars(ends[b - 1]), e, unit, len(sketch.items[item][1])))
                if rows:
                    of, item, start, end, edited, unit, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(item), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edited, pa.int32()), pa.array(unit, pa.string()), pa.array(n, pa.int32())], names=["id", "item", "start", "end", "edits", "unit", "item_words"])

        found = texts.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col if item_col != id_col else "item"})
