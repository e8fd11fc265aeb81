"""Removal of long byte strings that an earlier document already holds, by suffix arrays over anchored contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm._spark import Tables, byte_blocks

GRAM = 20
PIECE = 1 << 20
CHUNK = 2 << 20
HOT = 2000
BASE = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1


def constants(seed: int = 1) -> tuple[np.ndarray, int]:
    """A random 64-bit number for each byte, and the inverse of BASE modulo 2^64."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64, endpoint=False), pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Anchors:
    """Splits the windows of `length` bytes of a text by their anchor, the least hash of a `GRAM` bytes long gram.

    Equal windows have equal anchors, wherever they stand. Successive windows with the same anchor form a run; its
    context is the bytes from its first window's start to its last window's end.
    """

    def __init__(self, length: int) -> None:
        self.length, self.gram = length, min(GRAM, length)
        self.table, inverse = constants()
        self.up, self.down = powers(BASE, PIECE + 1), powers(inverse, PIECE + 1)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """A hash of the gram at each place, by doubling lengths."""
        parts, size, out, done, left = self.table[data], 1, None, 0, self.gram
        while True:
            if left & 1:
                out, done = (parts, size) if out is None else (self.joined(out, done, parts, size), done + size)
            left >>= 1
            if not left:
                return out
            parts, size = self.joined(parts, size, parts, size), size * 2

    @staticmethod
    def joined(a: np.ndarray, size: int, b: np.ndarray, other: int) -> np.ndarray:
        """Hashes of `size` + `other` bytes from those of `size` bytes and, behind them, of `other` bytes."""
        n = max(0, len(b) - size)
        return a[:n] * np.uint64(pow(BASE, other, 1 << 64)) + b[size : size + n]

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts that stand one after the other: (text, first window, windows, anchor's place, anchor, context hash) of each run; places in `data`."""
        n = len(data) - self.length + 1
        if n <= 0:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
        gram = mixed(self.grams(data))
        low = np.uint64(PIECE * 2 - 1)
        ranked = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        span, size, least = self.length - self.gram + 1, 1, ranked
        while size * 2 <= span:
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        place = (least & low).astype(np.int64)[:n]
        ok = np.ones(n, bool)
        for end in offsets[1:-1]:
            ok[max(0, end - self.length + 1) : end] = False
        new = np.empty(n, bool)
        new[0] = ok[0]
        np.not_equal(place[1:], place[:-1], out=new[1:])
        new[1:] |= ~ok[:-1]
        new &= ok
        first = np.flatnonzero(new)
        stop = np.empty(n, bool)
        stop[:-1] = new[1:] | ~ok[1:]
        stop[-1] = True
        stop &= ok
        last = np.flatnonzero(stop)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        context = mixed((sums[last + self.length] - sums[first]) * self.down[first] + (last - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        return np.searchsorted(offsets, first, side="right") - 1, first, last - first + 1, place[first], gram[place[first]], context

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...], np.ndarray]]:
        """Runs as of `runs`, of texts of any length: (place where the piece begins, its runs, its bytes)."""
        if len(data) <= PIECE:
            yield 0, self.runs(data, offsets), data
            return
        for at in range(0, max(1, len(data) - self.length + 1), PIECE - self.length):  # one long text
            part = data[at : at + PIECE - 1]
            yield at, self.runs(part, np.array([0, len(part)])), part


def two_stage(text: np.ndarray, ends: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Places of all windows in the order of their first `length` bytes.

    `text` holds rows one after the other, `ends` where each ends, `counts` of how many of its first places a window
    starts. Suffixes that are smaller than their successors are sorted directly; a scan over the buckets of first bytes
    in ascending order then induces the place of every other suffix from that of its successor.
    """
    n = len(text)
    starts = np.concatenate([[0], ends[:-1]])
    row_end = np.repeat(ends, ends - starts)
    same = np.empty(n, bool)
    same[:-1] = text[1:] == text[:-1]
    same[-1] = False
    same[ends - 1] = False
    larger = np.empty(n, bool)  # than its successor: type A; the end of a row is smaller than any byte
    larger[:-1] = text[:-1] > text[1:]
    larger[ends - 1] = True
    decided = np.where(same, n, np.arange(n))
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    larger = larger[decided]
    # of each row the windows, and what follows them up to the first place of type B, or the row's end
    index = np.arange(n)
    window = index - np.repeat(starts, ends - starts) < np.repeat(counts, ends - starts)
    next_b = np.minimum.accumulate(np.where(larger, n, index)[::-1])[::-1]
    last = starts + counts - 1
    reach = np.minimum(next_b[last], ends)
    taking = index <= np.repeat(reach, ends - starts)
    direct = np.flatnonzero(taking & ~larger)
    wide = -(-length // 8) * 8
    padded = np.concatenate([text, np.zeros(wide, np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, wide)[direct]
    short = row_end[direct] - direct
    cut = np.flatnonzero(short < wide)
    keys[cut] *= np.arange(wide) < short[cut, None]
    order = np.lexsort(keys.view(">u8").astype(np.uint64).T[::-1]) if len(direct) else np.zeros(0, np.int64)
    direct = direct[order]
    by_byte = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(places: np.ndarray, byte: int) -> np.ndarray:
        """Hands the predecessors of type A of sorted suffixes to their buckets; returns those of the same bucket."""
        before = places[places > 0] - 1
        before = before[taking[before] & larger[before]]
        first = text[before]
        mine = before[first == byte]
        rest = before[first != byte]
        if len(rest):
            first = text[rest]
            by = np.argsort(first, kind="stable")
            for group in np.split(rest[by], np.flatnonzero(np.diff(first[by])) + 1):
                waiting[text[group[0]]].append(group)
        return mine

    # a row's end is the smallest suffix; only rows without a place of type B after their windows begin there
    at_end = ends[reach == ends] - 1
    at_end = at_end[taking[at_end]]
    if len(at_end):
        by = np.argsort(text[at_end], kind="stable")
        for group in np.split(at_end[by], np.flatnonzero(np.diff(text[at_end][by])) + 1):
            waiting[text[group[0]]].append(group)
    ends_before = np.zeros(n + 1, bool)
    ends_before[ends] = True
    out = []
    for byte in range(256):
        here = waiting[byte]
        while here:
            group = np.concatenate(here)
            out.append(group)
            more = induce(group[~ends_before[group]], byte)
            here = [more] if len(more) else []
        if len(group := direct[by_byte[byte] : by_byte[byte + 1]]):
            out.append(group)
            induce(group[~ends_before[group]], byte)
    ordered = np.concatenate(out) if out else np.zeros(0, np.int64)
    return ordered[window[ordered]]


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Of how many bytes, up to `length`, the suffixes at `a` and at `b` begin alike."""
    out, alive = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for at in range(0, length, 8):
        width = min(8, length - at)
        view = np.lib.stride_tricks.sliding_window_view(text, width)
        where = np.flatnonzero(alive)
        equal = view[a[where] + at] == view[b[where] + at]
        whole = equal.all(axis=1)
        out[where] += np.where(whole, width, equal.argmin(axis=1))
        alive[where] = whole
    return out


def earlier(text: np.ndarray, ends: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts (rows of `text`) with their documents: (row, from, to) of the windows that a smaller document holds too."""
    starts = np.concatenate([[0], ends[:-1]])
    ordered = two_stage(text, ends, ends - starts - length + 1, length)
    row = np.searchsorted(ends, ordered, side="right")
    group = np.concatenate([[0], np.flatnonzero(common_prefix(text, ordered[:-1], ordered[1:], length) < length) + 1])
    least = np.repeat(np.minimum.reduceat(docs[row], group), np.diff(np.append(group, len(ordered))))
    gone = np.zeros(len(text) + 1, bool)
    gone[ordered[docs[row] > least]] = True
    edge = np.diff(gone, prepend=False)
    begin = np.flatnonzero(gone & edge)
    # a run of places stops where the row's windows stop, as the last places of a row start no window
    stop = np.flatnonzero(~gone & edge)
    of = np.searchsorted(ends, begin, side="right")
    return of, begin - starts[of], stop - starts[of]


def found_runs(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, context, doc) of each distinct run of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for rows, data, offsets in byte_blocks(batches, "text", PIECE // 2):
            ids = rows.column(0).to_numpy()
            for _, (of, _, _, _, anchor, context), _ in anchors.pieces(data, offsets):
                doc = ids[of]
                _, one = np.unique(mixed(context + of.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[one].view(np.int64)), pa.array(context[one].view(np.int64)), pa.array(doc[one])], names=["anchor", "context", "doc"])

    return docs.mapInArrow(work, "anchor long, context long, doc long")


def contexts_to_sort(docs: DataFrame, length: int) -> DataFrame:
    """The contexts (doc, context, base, bytes) that `sort` names, in two parts by side, with the key of the group in which equal windows meet.

    A window of 50 bytes has either half or more of what it holds besides its anchor before it, or behind it; the key is
    a hash of the anchor and of that half next to it, so that a frequent anchor is split by what stands beside it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        rest = length - anchors.gram
        left = rest // 2
        right = rest - left + 1 if rest else 0
        for rows, data, offsets in byte_blocks(batches, "text", PIECE // 2):
            ids, wanted = rows.column(0).to_numpy(), rows.column(2).to_pylist()
            for _, (of, first, count, place, anchor, context), part in anchors.pieces(data, offsets):
                pick = np.concatenate([np.flatnonzero(of == i)[np.isin(context[of == i], np.array(wanted[i], np.int64).view(np.uint64))] for i in np.unique(of)]) if len(of) else of
                _, one = np.unique(mixed(context[pick] + of[pick].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)
                pick = pick[one]
                if not len(pick):
                    continue
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(anchors.table[part] * anchors.up[: len(part)], out=sums[1:])
                out: list[list] = [[], [], [], [], []]
                lo, hi, mid = first[pick], first[pick] + count[pick], np.clip(place[pick] - left + 1, first[pick], first[pick] + count[pick])
                for a, b, side in ((lo, mid, 0), (mid, hi, 1)):
                    some = np.flatnonzero(b > a)
                    p = place[pick[some]]
                    s, e = (p - left, p) if side == 0 else (p + anchors.gram, p + anchors.gram + right)
                    key = mixed(anchor[pick[some]] + mixed((sums[e] - sums[s]) * anchors.down[s]) * np.uint64(3) + np.uint64(side))
                    out[0].append(key.view(np.int64))
                    out[1].append(ids[of[pick[some]]])
                    out[2].append(context[pick[some]].view(np.int64))
                    out[3].append(a[some] - lo[some])
                    out[4] += [part[x : y + length - 1].tobytes() for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out[:4]), pa.array(out[4], pa.binary())], names=["key", "doc", "context", "base", "bytes"])

    return docs.mapInArrow(work, "key long, doc long, context long, base long, bytes binary")


def sorted_contexts(parts: DataFrame, length: int) -> DataFrame:
    """(doc, context, from, to): windows of contexts, relative to the first, that smaller documents hold in other contexts. Sorts groups of a key, many together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, CHUNK

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            keys = rows.column("key").to_numpy()
            cut = np.flatnonzero(np.diff(keys)) + 1
            group = np.searchsorted(cut, np.arange(len(keys)), side="right")
            several = np.bincount(group)[group] > 1
            rows = rows.filter(pa.array(several))
            if not rows.num_rows:
                return
            col = rows.column("bytes").combine_chunks()
            if isinstance(col, pa.ChunkedArray):
                col = col.chunk(0)
            offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            text = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            of, a, b = earlier(text, offsets[1:] - offsets[0], rows.column("doc").to_numpy(), length)
            base = rows.column("base").to_numpy()[of]
            yield pa.RecordBatch.from_arrays([pa.array(rows.column("doc").to_numpy()[of]), pa.array(rows.column("context").to_numpy()[of]), pa.array(base + a), pa.array(base + b)], names=["doc", "context", "from", "to"])

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                piece = batch.slice(start, 4096)
                held.append(piece)
                size += piece.column(4).nbytes
                if size < limit:
                    continue
                rows = pa.Table.from_batches(held)
                keys = rows.column("key").to_numpy()
                whole = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0  # the last key may go on
                if whole:
                    yield from done(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                size = sum(x.column(4).nbytes for x in held)
                limit = CHUNK if whole else 2 * size
        if held:
            yield from done(pa.Table.from_batches(held))

    return parts.mapInArrow(work, "doc long, context long, from long, to long")


def single_windows(parts: DataFrame, length: int) -> DataFrame:
    """(one, two, doc, context, at): each window of contexts by a 128-bit hash of its bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = []
        for seed in (3, 4):
            own = Anchors(length)
            own.gram, own.table = length, constants(seed)[0]
            hashes.append(own)
        for rows, data, offsets in byte_blocks(batches, "bytes", PIECE // 2):
            at = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            of = np.searchsorted(offsets, at, side="right") - 1
            one, two = (mixed(x.grams(data))[at].view(np.int64) for x in hashes)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(rows.column(1).to_numpy()[of]), pa.array(rows.column(2).to_numpy()[of]), pa.array(rows.column(3).to_numpy()[of] + at - offsets[of])], names=["one", "two", "doc", "context", "at"])

    return parts.mapInArrow(work, "one long, two long, doc long, context long, at long")


def split_groups(parts: DataFrame, length: int, tables: Tables) -> DataFrame:
    """What `sorted_contexts` finds, for groups of any size.

    A group of more than HOT contexts, such as those around a passage that a third of all documents quote, is not sorted
    in one task: its windows are dealt out one by one, and meet their first document through an aggregate that combines
    before the shuffle and a join whose hot keys adaptive execution can split.
    """
    parts = tables.write(parts, "parts")
    hot = tables.write(parts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "hot")
    cold = sorted_contexts(parts.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key"), length)
    if hot.isEmpty():
        return cold
    windows = single_windows(parts.join(hot, "key", "left_semi").select("key", "doc", "context", "base", "bytes"), length)
    least = tables.write(windows.groupBy("one", "two").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last"), "least")
    found = windows.join(least, ["one", "two"]).filter("doc > first").select("doc", "context", F.col("at").alias("from"), (F.col("at") + 1).alias("to"))
    return cold.unionByName(found)


def remove_repeats(docs: DataFrame, length: int = 50, characters: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Takes out of every document each byte covered by a string of `length` bytes that a document of smaller id also holds.

    Texts are UTF-8 bytes. Strings are judged on the input, may overlap, and never cross documents. Returns id, n_bytes,
    kept (binary: the other bytes), spans (array of start and end, the maximal runs taken out, in bytes of the text),
    n_removed, and behind them the columns named in `carry`. With `characters`, a character of which only some bytes are covered stays whole.

    1. Every window of `length` bytes belongs to the run of its anchor, the gram of least hash in it. One shuffle by anchor
       finds which contexts a smaller document also holds (there all windows go), and which anchors stand in several
       contexts of several documents. Contexts are hashes until then.
    2. Only those contexts, one copy of each, are then read as bytes, grouped by anchor and neighbourhood, and sorted into
       suffix arrays by two-stage sorting; adjacent suffixes that share `length` bytes show which windows are earlier elsewhere.
    3. Both decisions are joined to the documents, which apply them to all their copies of a context.

    A null text is empty. A null id ranks after all others. Rows of equal id do not affect each other; equal rows give
    equal rows. Texts shorter than `length` stay as they are. Other columns are not read.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "suffix")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("text"))
    runs = found_runs(own.filter(F.octet_length("text") >= length), length)
    context, anchor = Window.partitionBy("anchor", "context"), Window.partitionBy("anchor")
    judged = (
        runs.withColumn("first", F.min("doc").over(context))
        .withColumns({"low": F.min("doc").over(anchor), "high": F.max("doc").over(anchor), "one": F.min("context").over(anchor), "other": F.max("context").over(anchor)})
        .filter("low <> high and (doc > first or one <> other)")
        .groupBy("doc").agg(F.collect_set(F.expr("case when doc > first then context end")).alias("gone"), F.collect_set(F.expr("case when doc = first then context end")).alias("sort"))
    )
    judged = tables.write(judged, "judged")
    parts = contexts_to_sort(own.join(judged.filter("size(sort) > 0"), "doc").select("doc", "text", "sort"), length)
    partly = split_groups(parts, length, tables)
    partly = tables.write(partly.groupBy("doc").agg(F.collect_list(F.struct("context", "from", "to")).alias("partly")), "partly")
    for part in ("parts", "hot", "least"):
        tables.drop(part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for rows, data, offsets in byte_blocks(batches, "text", PIECE // 2):
            gone, some = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            covered = np.zeros(len(data) + 1, np.int32)
            if any(gone) or any(some):
                for at, (of, first, count, _, _, context), _ in anchors.pieces(data, offsets):
                    key = context.view(np.int64)
                    begin = np.searchsorted(of, np.arange(rows.num_rows + 1))
                    for i in range(rows.num_rows):
                        a, b = begin[i], begin[i + 1]
                        if gone[i] and b > a:
                            hit = a + np.flatnonzero(np.isin(key[a:b], np.array(gone[i], np.int64)))
                            np.add.at(covered, at + first[hit], 1)
                            np.add.at(covered, at + first[hit] + count[hit] - 1 + length, -1)
                        if some[i] and b > a:
                            names = np.array([x["context"] for x in some[i]], np.int64)
                            by = np.argsort(names, kind="stable")
                            froms, tos = np.array([x["from"] for x in some[i]])[by], np.array([x["to"] for x in some[i]])[by]
                            lo, hi = np.searchsorted(names[by], key[a:b]), np.searchsorted(names[by], key[a:b], side="right")
                            for j in np.flatnonzero(hi > lo):
                                x = slice(lo[j], hi[j])
                                np.add.at(covered, at + first[a + j] + froms[x], 1)
                                np.add.at(covered, at + first[a + j] + tos[x] - 1 + length, -1)
            mask = np.cumsum(covered[:-1]) > 0
            if characters:
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(mask, lead) if len(lead) else mask
                mask = np.repeat(whole, np.diff(np.append(lead, len(data)))) if len(lead) else mask
            kept, spans, removed = [], [], []
            for i in range(rows.num_rows):
                own_mask = mask[offsets[i] : offsets[i + 1]]
                edge = np.flatnonzero(np.diff(own_mask, prepend=False, append=False))
                spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
                removed.append(int((edge[1::2] - edge[::2]).sum()))
                kept.append((data[offsets[i] : offsets[i + 1]][~own_mask] if len(edge) else data[offsets[i] : offsets[i + 1]]).tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), *rows.columns[4:]], names=["id", "n_bytes", "n_removed", "spans", "kept", *schema.names[5:]])

    joined = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("text"), *(F.col(c).alias(f"carried{i}") for i, c in enumerate(carry)))
        .join(judged.select("doc", "gone"), "doc", "left").join(partly, "doc", "left").select("id", "text", "gone", "partly", *(f"carried{i}" for i in range(len(carry))))
    )
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary").fields, *joined.schema.fields[4:]])
    return joined.mapInArrow(cut, schema).toDF(id_col, *schema.names[1:5], *carry)


SQL = """
with d as (select doc_id, coalesce(doc_id, 9223372036854775807) as r, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, r, unnest(range(0, greatest(0, length(h) // 2 - 49))) as p, h from d),
x as (select doc_id, r, p, substr(h, 2 * p + 1, 100) as s from w),
m as (select s, min(r) as least from x group by s having min(r) < max(r)),
g as (select doc_id, p from x join m using (s) where r > least),
i as (select doc_id, p, sum(case when p > before + 50 or before is null then 1 else 0 end) over (partition by doc_id order by p) as island from (select *, lag(p) over (partition by doc_id order by p) as before from g)),
spans as (select doc_id, min(p) as a, max(p) + 50 as b from i group by doc_id, island),
parts as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as from_ from spans),
cut as (select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans, max(b) as last, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' order by a) as kept from parts join d using (doc_id) group by doc_id)
select d.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(case when kept is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256
from d left join cut using (doc_id)
"""
