"""Language identification by blended-spectrum string kernels with Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm._spark import byte_blocks, checkpoint, least_hashes

BITS = 15
GRAMS = (2, 3, 4)
PER_LANGUAGE = 400
LANDMARKS = 96
RIDGE = 1e-3
BLOCK = 1 << 19
BATCH = 128
LETTERS = np.full(256, 32, np.uint8)
for low in (*range(97, 123), *range(128, 256)):
    LETTERS[low] = low


def presence(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Of each text which n-grams of bytes it holds, hashed into 2^15 slots; all but letters count as a space."""
    codes = LETTERS[data].astype(np.uint32)
    slots = []
    for n in GRAMS:
        gram = np.zeros(max(0, len(codes) - n + 1), np.uint32)
        for i in range(n):
            gram = gram << np.uint32(8) | codes[i : i + len(gram)]
        slots.append(((gram ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        flags = np.zeros(1 << BITS, np.uint8)
        for n, own in zip(GRAMS, slots, strict=True):
            flags[own[a : max(a, b - n + 1)]] = 1
        yield flags


def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the bytes of their texts in lower case."""
    for rows, _, _ in byte_blocks(batches, "text", BLOCK):
        lower = pc.utf8_lower(rows.column(rows.schema.get_field_index("text")))
        yield from ((rows, data, offsets) for _, data, offsets in byte_blocks(iter([pa.RecordBatch.from_arrays([lower], names=["text"])]), "text", 1 << 62))


class Model:
    """One-versus-rest kernel ridge regression on the normalised presence kernel, through landmarks.

    The kernel of two texts is the number of n-grams they share over the root of the product of theirs. Texts are
    mapped to the landmarks' span (Nyström), where ridge regression on 0 and 1 is solved for each language; both
    steps fold into one matrix, so that a batch of texts is scored by two matrix products.
    """

    def __init__(self, flags: np.ndarray, languages: list[str], landmarks: int = LANDMARKS) -> None:
        self.names = sorted(set(languages))
        which = np.array([self.names.index(x) for x in languages])
        turn = np.empty(len(which), np.int64)  # the first of each language, then the second, ...
        for c in range(len(self.names)):
            turn[which == c] = np.arange((which == c).sum())
        chosen = np.lexsort((which, turn))[: max(landmarks, len(self.names))]
        self.marks = np.packbits(flags[chosen], axis=1)
        self.open()
        near = self.kernel(flags)
        values, vectors = np.linalg.eigh(near[chosen].astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        mapped = near @ root
        targets = (which[:, None] == np.arange(len(self.names))[None]).astype(float)
        weight = 1 / np.bincount(which)[which]
        ridge = (mapped * weight[:, None]).T @ mapped + RIDGE * np.eye(len(root))
        self.weights = (root @ np.linalg.solve(ridge, (mapped * weight[:, None]).T @ targets)).astype(np.float32)

    def open(self) -> None:
        marks = np.unpackbits(self.marks, axis=1).astype(np.float32)
        self.columns = (marks / np.sqrt(np.maximum(1, marks.sum(axis=1, keepdims=True)))).T.copy()

    def kernel(self, flags: np.ndarray) -> np.ndarray:
        x = flags.astype(np.float32)
        return x @ self.columns / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))

    def scores(self, flags: np.ndarray) -> np.ndarray:
        return self.kernel(flags) @ self.weights


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5


def learn(docs: DataFrame, per_language: int, landmarks: int, id_col: str, text_col: str, lang_col: str) -> tuple | None:
    """Fits a model on at most `per_language` texts of each language, those of least hash, of the folds that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("id")) != 0) & F.col("text").rlike(r"\p{L}"))
    hashed = rows.select("lang", F.xxhash64("text").alias("h")).persist()
    least = checkpoint(least_hashes(hashed, "lang", "h", per_language))
    hashed.unpersist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in lowered(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([np.packbits(x).tobytes() for x in presence(data, offsets)], pa.binary())], names=["lang", "h", "flags"])

    texts = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(least), ["lang", "h"]).select("lang", "h", "text")  # at most `per_language` rows of 16 bytes each language
    found = texts.mapInArrow(work, "lang string, h long, flags binary").dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()
    if not found:
        return None
    model = Model(np.unpackbits(np.frombuffer(b"".join(x.flags for x in found), np.uint8).reshape(len(found), -1), axis=1), [x.lang for x in found], landmarks)
    return model.names, model.marks, model.weights


def languages(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """Predicts the language of every whole text: id, held_out, lang_pred, score, and behind them the columns named in `carry`.

    Learns from texts and non-null languages of rows whose crc32(id as text) mod 5 is not 0: at most `per_language` (400)
    distinct texts of each language, of which 96 are landmarks. From the texts only bit sets of 4 KiB are gathered, however
    long they are. Every text is then scored by all its n-grams of two to four bytes; the predicted language has the
    highest regression value, and the score is that value within 0 and 1: near 0 for texts unlike any learned ones.

    A text that is null or has no letter is `und` with score 0, as are all texts if there is nothing to learn from. A null
    id counts as an empty text for the fold. Repeated rows and extra columns make no difference.
    """
    fitted = learn(docs, per_language, landmarks, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        if sent.value:
            model = Model.__new__(Model)
            model.names, model.marks, model.weights = sent.value
            model.open()
        for rows, data, offsets in lowered(batches):
            count = rows.num_rows
            best, score = np.zeros(count, np.int64), np.zeros(count)
            spoken = rows.column(2).to_numpy(zero_copy_only=False).astype(bool) if model else np.zeros(count, bool)
            held: list[np.ndarray] = []
            done = 0
            for i, flags in enumerate(presence(data, offsets) if model else ()):
                held.append(flags)
                if len(held) == BATCH or i == count - 1:
                    values = model.scores(np.stack(held))
                    best[done : i + 1] = values.argmax(axis=1)
                    score[done : i + 1] = np.clip(values.max(axis=1), 0, 1)
                    held, done = [], i + 1
            names = [model.names[b] if ok else "und" for b, ok in zip(best.tolist(), spoken.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(np.where(spoken, score, 0.0)), *(rows.column(rows.schema.get_field_index("text" if c == text_col else f"carried{i}")) for i, c in enumerate(carry))], names=schema.names)

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col)) == 0).alias("held_out"), letters.alias("spoken"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carried{i}") for i, c in enumerate(carry) if c != text_col))
    back = [T.StructField(f"carried{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("held_out boolean, lang_pred string, score double").fields, *back])
    return rows.mapInArrow(work, schema).toDF(id_col, *schema.names[1:4], *carry)
