"""Quality of documents: a text classifier combined with what its site and section lead one to expect (empirical Bayes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm._spark import Tables, byte_blocks, checkpoint, least_hashes
from docledger.llm.decontam import AlnumWords
from docledger.llm.suffix import mixed

WORD_BITS = 15
SHAPES = 512
PER_CLASS = 2000
BLOCK = 1 << 19
CLASSES = np.arange(256, dtype=np.uint32)
CLASSES[48:58], CLASSES[65:91], CLASSES[97:123], CLASSES[128:] = 1, 2, 3, 3


def features(words: AlnumWords, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the slots of its distinct words, and the roots of the shares of its trigrams of character classes."""
    own, _, _, begin = words.hashes(data, offsets)
    slots = (mixed(own) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    kind = CLASSES[data]
    shape = ((kind[:-2] << np.uint32(16) | kind[1:-1] << np.uint32(8) | kind[2:]) * np.uint32(0x9E3779B1) >> np.uint32(23)).astype(np.int64) if len(kind) > 2 else np.zeros(0, np.int64)
    for i in range(len(offsets) - 1):
        counts = np.bincount(shape[offsets[i] : max(offsets[i], offsets[i + 1] - 2)], minlength=SHAPES)
        yield np.unique(slots[begin[i] : begin[i + 1]]), np.sqrt(counts / max(1, counts.sum()))


def regression(slots: list[np.ndarray], dense: np.ndarray, y: np.ndarray, ridge: float = 0.5, turns: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of word slots and of dense columns, and the intercept, of a logistic regression with classes of equal weight; accelerated gradient steps on sparse rows."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    row = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
    slot = np.concatenate(slots)
    seen = np.bincount(slot, minlength=1 << WORD_BITS) >= 3  # rarer words only tell single documents
    row, slot = row[seen[slot]], slot[seen[slot]]
    dense = np.hstack([dense, np.ones((len(dense), 1))])
    times = lambda w: np.bincount(row, w[slot], len(y)) + dense @ w[1 << WORD_BITS :]
    back = lambda g: np.concatenate([np.bincount(slot, g[row], 1 << WORD_BITS), dense.T @ g])
    top = np.ones((1 << WORD_BITS) + dense.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the step
        top = back(share * times(top / np.linalg.norm(top)))
    step = 1 / (np.linalg.norm(top) / 4 * 1.1 + ridge)
    w = ahead = np.zeros(len(top))
    for n in range(turns):
        grad = back(share * (1 / (1 + np.exp(-np.clip(times(ahead), -30, 30))) - y)) + ridge * np.append(ahead[:-1], 0)
        new = ahead - step * grad
        ahead, w = new + n / (n + 3) * (new - w), new
    return w[: 1 << WORD_BITS], w[1 << WORD_BITS : -1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple | None:
    """Fits the classifier of good texts on at most `per_class` labelled documents of each class (good, poor, toxic)."""
    marked = labels.groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("id is not null and quality is not null")
    kind = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").otherwise("good")
    chosen = checkpoint(least_hashes(marked.select(kind.alias("kind"), "id"), "kind", "id", per_class))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = AlnumWords(1)
        for rows, data, offsets in byte_blocks(batches, "text", BLOCK):
            found = list(features(words, data, offsets))
            flags = np.zeros((len(found), 1 << WORD_BITS), np.uint8)
            for i, (slots, _) in enumerate(found):
                flags[i, slots] = 1
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([x.tobytes() for x in np.packbits(flags, axis=1)], pa.binary()), pa.array([s.astype(np.float32).tobytes() for _, s in found], pa.binary())], names=["id", "kind", "words", "shapes"])

    # three rows of at most `per_class` each are sent to all tasks
    texts = docs.join(F.broadcast(chosen), "id").select("id", "kind", "text").filter("text is not null")
    schema = T.StructType([texts.schema["id"], *T._parse_datatype_string("kind string, words binary, shapes binary").fields])
    found = texts.mapInArrow(work, schema).dropDuplicates(["id"]).orderBy("id").collect()
    good = np.array([x.kind == "good" for x in found])
    if not good.any() or good.all():
        return None
    slots = [np.flatnonzero(np.unpackbits(np.frombuffer(x.words, np.uint8))) for x in found]
    shapes = np.frombuffer(b"".join(x.shapes for x in found), np.float32).reshape(len(found), -1)
    by_word, by_shape, b = regression(slots, 10.0 * shapes, good.astype(float))
    return by_word.astype(np.float32), (10 * by_shape).astype(np.float32), b


def evidence(docs: DataFrame, fitted: tuple | None) -> DataFrame:
    """Adds to (id, host, path, text) the log likelihood ratio of good against not good; drops the text."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = AlnumWords(1)
        for rows, data, offsets in byte_blocks(batches, "text", BLOCK):
            ratios = np.zeros(rows.num_rows)
            if sent.value:
                by_word, by_shape, b = sent.value
                for i, (slots, shapes) in enumerate(features(words, data, offsets)):
                    ratios[i] = by_word[slots].sum(dtype=np.float64) + float(by_shape @ shapes) + b if offsets[i + 1] > offsets[i] else 0.0
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(np.clip(ratios, -30, 30))], names=["id", "host", "path", "ratio"])

    schema = T.StructType([docs.schema["id"], docs.schema["host"], docs.schema["path"], T.StructField("ratio", T.DoubleType())])
    return docs.select("id", "host", "path", "text").mapInArrow(work, schema)


def strength(sums: DataFrame, mean: Column) -> float:
    """How many documents a prior is worth, by moments: groups (n, good) whose means vary about `mean` more than samples of their size would."""
    rate = F.col("good") / F.col("n")
    noise = mean * (1 - mean) / F.col("n")
    row = sums.agg(F.sum(F.col("n") * ((rate - mean) ** 2 - noise)).alias("over"), F.sum(F.col("n") * mean * (1 - mean)).alias("all"), F.sum("n").alias("n")).first()
    if not row.n or not row["all"]:
        return 1.0
    share = min(0.999, max(1e-4, (row.over or 0.0) / row["all"]))
    return (1 - share) / share


def posteriors(docs: DataFrame, labels: DataFrame, host: Column, path: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """The probability that each document is good (quality 1 and not toxic): id, p_text, n_host, n_path, p_host, p_path, posterior, keep.

    A logistic regression on words and character classes, fitted on at most `per_class` (2000) labelled documents of each of
    three classes, gives each whole text's evidence. Grouped sums over all documents give the rates of hosts and of paths
    within hosts. A host's rate is shrunk towards the global rate, a path's towards its host's, each by as many documents
    as the spread of the rates says (method of moments), so sparse sites stay near their parent. A document's prior is
    its path's rate without the document itself; the posterior adds its evidence to the prior's log odds.

    A null or empty text brings no evidence, so its posterior is its prior. Null hosts and paths are groups of their own.
    Labels that are null count for nothing; of several labels of an id the worst counts. Without labels of both kinds no
    text brings evidence. Repeated rows are separate documents; extra columns are not read. Groups combine before the shuffle.
    """
    tables = Tables(docs.sparkSession, "quality")
    own = docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))
    fitted = learn(own.select("id", "text"), labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("quality"), F.col(toxic_col).alias("toxic")), per_class)
    scored = tables.write(evidence(own, fitted).withColumn("p", 1 / (1 + F.exp(-F.col("ratio")))), "scored")
    paths = tables.write(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(1 - 1e-6, max(1e-6, (total.good or 0.0) / total.n)) if total.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    by_host = strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("n_host"), ((F.col("good") + by_host * rate) / (F.col("n") + by_host)).alias("p_host"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    by_path = strength(joined, F.col("p_host"))
    sites = tables.write(joined.select(F.col("host").alias("h"), F.col("path").alias("q"), "n_host", F.col("n").alias("n_path"), "good", "p_host", ((F.col("good") + by_path * F.col("p_host")) / (F.col("n") + by_path)).alias("p_path")), "sites")
    tables.drop("paths")
    prior = (F.col("good") - F.col("p") + by_path * F.col("p_host")) / (F.col("n_path") - 1 + by_path)
    prior = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("ratio") + F.log(F.col("prior") / (1 - F.col("prior")))
    return (
        scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
        .withColumn("prior", prior).withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .select(F.col("id").alias(id_col), F.col("p").alias("p_text"), "n_host", "n_path", "p_host", "p_path", "posterior", (F.col("posterior") >= 0.5).alias("keep"))
    )
