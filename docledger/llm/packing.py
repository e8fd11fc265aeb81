"""Packing of tokenized documents into sequences of fixed length by bulk-synchronous best-fit decreasing.

Documents are range-sorted by length, and gaps (what is left of open sequences) by room. In each step all documents of
one length, longest first, are matched at once with the gaps that succeed it: the smallest that hold them. Which document
gets which of them is settled by its rank among those of its length; the gaps are updated, and the next length follows.
Documents and gaps of one size are alike, so a step needs their numbers only, and no more than one entry for each size; ranks
are made, and turned into places, where the documents are.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm._spark import Ranges, Tables, byte_blocks, runs

CAPACITY = 4096
END = 1
#: Words whose ids a worker remembers, and bytes of text that it takes at a time.
WORDS, BYTES = 400_000, 8 << 20
#: Letters and digits below U+0250, where no version of Unicode, normal form or case rule makes a difference but for LONGER.
LETTERS, NUMBERS, BLANKS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
LONGER = "\u0130"  # becomes two characters in lower case
LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
OTHER = re.compile(f"[^\\x00-\u024f]|{LONGER}")
WORD_END = "</w>"


class Words:
    """Ids of texts, word by word.

    The vocabulary never joins characters across white space, so a text's ids are those of what stands between ASCII spaces.
    Each such string is looked up once for many texts. Latin ones are cut into the words of the vocabulary's own splitter,
    of which there are fewer, and those are remembered; others are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # what looks like a special token is text
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Ids of Latin words: many at a time, apart by the tokens that end a word."""
        ids = np.array([i for own in self.encode([" ".join(words[at : at + 64]) for at in range(0, len(words), 64)]) for i in own], "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) == len(words):
            data = ids.tobytes()
            self.known.update(zip(words, (data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))
        else:
            self.known.update((word, np.array(own, "<u4").tobytes()) for word, own in zip(words, self.encode(words), strict=True))

    def strings(self, strings: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of strings without spaces, one after the other, and how many each has."""
        if len(self.known) > WORDS:
            self.known.clear()
        words: list[str] = []
        upto = [0]
        for x in strings:
            if x.isascii() and x.isalpha():
                words.append(x.lower())
            elif OTHER.search(x):
                words.append(x)
            else:
                words += LATIN_WORD.findall(x.lower())
            upto.append(len(words))
        found = list(map(self.known.get, words))
        if None in found:
            new = {word for word, ids in zip(words, found, strict=True) if ids is None}
            other = [word for word in new if OTHER.search(word)]
            if latin := list(new.difference(other)):
                self.learn(latin)
            self.known.update((word, np.array(ids, "<u4").tobytes()) for word, ids in zip(other, self.encode(other), strict=True))
            found = list(map(self.known.__getitem__, words))
        sizes = np.cumsum([0, *map(len, found)]) // 4
        return b"".join(found), np.diff(sizes[upto])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Little-endian unsigned 32-bit ids of texts (their bytes, and where each begins and ends), and where each text's begin and end."""
        blank = (data == 32) | (data == 9) | (data == 10) | (data == 13)
        begins = ~blank
        begins[1:] &= blank[:-1]
        inner = offsets[1:-1][offsets[1:-1] < len(data)]
        begins[inner] = ~blank[inner]  # a text begins a string of its own
        at = np.flatnonzero(begins)
        full = np.concatenate(([0], np.cumsum(~blank)))  # bytes before each place that are not blank
        places = np.append(full[at], full[-1]).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(data[~blank])])
        coded = column.dictionary_encode()
        made, sizes = self.strings(coded.dictionary.cast(pa.large_string()).to_pylist())
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), pa.array(np.frombuffer(made, "<u4")))
        each = coded.indices.to_numpy()
        upto = np.concatenate(([0], np.cumsum(sizes[each])))
        return lists.take(coded.indices).flatten().to_numpy(), upto[np.searchsorted(at, offsets)]


@cache
def words_of(path: str) -> Words:
    """Kept by a worker from task to task."""
    return Words(path)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a number of bytes."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.nbytes for b in waiting) >= limit:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting = []
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of tokenized documents: uid, the id, piece, start, length, ids_crc32, and with `with_ids` their ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()
    names = ["uid", "id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, uid = words_of(path), TaskContext.get().partitionId() << 40
        for batch, data, offsets in byte_blocks(gathered(batches, BYTES), "text", BYTES):
            rows: list[list] = [[] for _ in names[2:]]
            of = []
            ids, upto = words.ids(data, offsets)
            for at in range(batch.num_rows):
                own_ids = ids[upto[at] : upto[at + 1]].tobytes() + last
                for start in range(0, len(own_ids) // 4, capacity):
                    own = own_ids[4 * start : 4 * (start + capacity)]
                    of.append(at)
                    for column, value in zip(rows, (start // capacity, start, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32)), strict=False):
                        column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + len(of)), pa.int64()), batch.column(0).take(pa.array(of, pa.int32())), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=False))], names=names)
            uid += len(of)

    schema = f"uid long, id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Moves of best-fit decreasing over so many documents of each length, and the number of sequences.

    Each step takes the documents of one length. Gaps that can hold them are swept from the smallest: each takes as many as
    fit, before the next is touched, which is what best-fit does with them one by one. A move (length, rank, each, gaps, sequence, offset)
    puts documents from a rank on into consecutive sequences, so many in each, from an offset on.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)
    rooms: list[int] = []
    moves: list[tuple[int, ...]] = []
    opened = 0

    def fill(length: int, rank: int, left: int, room: int, first: int, n: int) -> Iterator[tuple[int, int, int]]:
        """Moves up to `left` documents into up to n gaps of a room: (documents in each, gaps, room that is left)."""
        each = room // length
        whole = min(n, left // each)
        rest = left - whole * each if whole < n else 0
        for number, count, sequence in ((each, whole, first), (rest, 1, first + whole)):
            if number and count:
                moves.append((length, rank, number, count, sequence, capacity - room))
                rank += number * count
                yield number, count, room - number * length

    for length in sorted(counts, reverse=True):
        left, rank, freed, at = counts[length], 0, [], bisect_left(rooms, length)
        while left:
            if at < len(rooms):
                room, own = rooms[at], gaps[rooms[at]]
                first, n = own.pop()
            else:
                room, own, first, n = capacity, [], opened, -(-left // (capacity // length))
                opened += n
            touched = 0
            for number, count, after in fill(length, rank, left, room, first, n):
                freed.append((after, first + touched, count))
                left, rank, touched = left - number * count, rank + number * count, touched + count
            if touched < n:
                own.append((first + touched, n - touched))
            if at < len(rooms) and not own:
                del gaps[rooms.pop(at)]
        for room, first, n in freed:
            if room:
                if room not in gaps:
                    insort(rooms, room)
                gaps.setdefault(room, []).append((first, n))
    return np.array(moves, np.int64).reshape(-1, 6), opened


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows (uid, id, length of 1 to capacity, any others) with sequence_id and offset; sequences are filled from 0 without gaps."""
    ranges = Ranges(rows, "length", "id", "uid")
    moves, _ = best_fit(ranges.totals, capacity)
    before = ranges.before
    begins = {int(moves[a, 0]): moves[a:b] for a, b in runs(moves[:, 0].tolist())} if len(moves) else {}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = dict(before.get(TaskContext.get().partitionId(), {}))
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for start, stop in runs(lengths):
                length = lengths[start]
                rank = np.arange(at[length], at[length] + stop - start)
                at[length] += stop - start
                own = begins[length]
                move = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                turn = rank - move[:, 1]
                sequence[start:stop] = move[:, 4] + turn // move[:, 2]
                offset[start:stop] = move[:, 5] + turn % move[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranges.rows.schema)
    return ranges.rows.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents tokenized, ended with an id, cut into pieces only where they are longer than the capacity, and packed.

    `path` names the vocabulary (tokenizers' JSON); it has to be there on all executors. Returns for each piece the id,
    piece (from 0), start (its document's ids before it), length, ids_crc32 (of its ids as little-endian unsigned 32 bits), sequence_id,
    offset, and with `with_ids` the ids.

    A null or empty text is one piece that is only the end. Rows of equal or null id are documents of their own. Long texts are
    tokenized whole. An empty table gives no rows. Extra columns are not read. The driver holds the number of pieces of each
    length in each partition, which for sorted rows is at most partitions and capacity together, and one entry for each size of gap.
    """
    tables = Tables(docs.sparkSession, "packing")
    made = tables.write(pieces(docs, path, capacity, end, id_col, text_col, with_ids), "pieces")
    placed = pack(made.select("uid", "id", "piece", "start", "length", "ids_crc32"), capacity)
    if with_ids:
        placed = placed.join(made.select("uid", "ids"), "uid")
    else:
        tables.drop()
    return placed.drop("uid").withColumnRenamed("id", id_col)


def sequences(placed: DataFrame) -> DataFrame:
    """Packed pieces with ids as whole sequences: sequence_id, ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most one sequence's ids
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda p: p["ids"])).alias("ids"))
