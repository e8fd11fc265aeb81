"""Exact search for the highest inner products in a paged M-tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm._spark import Tables

CELLS = 256
PAGE = 4096
LEAF = 64
BLOCK = 1024
FANOUT = 512
LAST = (1 << 63) - 1
RANKS = 14
EXACT = float(1 << 48)
LOW = -(1 << 63)


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, norm, vec): components floor(scale * x) as int64; vectors that are null, empty or hold null or non-finite components are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, norms, vecs, dims = [], [], [], []
            for key, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if row.as_py() is None or not len(row) or row.values.null_count:
                    continue
                x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    v = np.clip(np.floor(x * scale), -(2.0**62), 2.0**62).astype(np.int64)
                    ids.append(key)
                    dims.append(len(v))
                    norms.append(float((v.astype(np.float64) ** 2).sum()))
                    vecs.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(vecs, pa.binary())], names=["id", "dim", "norm", "vec"])

    return vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), vec_col).mapInArrow(work, "id long, dim int, norm double, vec binary")


def lifted(rows: np.ndarray, most: float) -> np.ndarray:
    """Adds a component that makes all squared norms `most`: the nearest is then the one of highest inner product."""
    x = rows.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)))


class Node:
    """A page of the tree: a routing object with its covering radius, leaves with theirs and their distance from it, entries with their distance from their leaf's."""

    KINDS = {"dim": "int", "radius": "double", "pivot": "binary", "leaf_pivots": "binary", "leaf_radii": "binary", "leaf_far": "binary", "leaf_ends": "binary", "ids": "binary", "rows": "binary", "far": "binary"}

    @staticmethod
    def build(ids: np.ndarray, rows: np.ndarray, most: float) -> dict:
        by = np.argsort(ids, kind="stable")
        ids, rows = ids[by], rows[by]
        x = lifted(rows, most)
        pivot = int(distances(x.mean(axis=0)[None], x)[0].argmin())
        leaves = np.unique(np.linspace(0, len(x) - 1, -(-len(x) // LEAF)).astype(int))
        apart = distances(x, x[leaves])
        leaf = apart.argmin(axis=1)
        order = np.argsort(leaf, kind="stable")
        far = apart[np.arange(len(x)), leaf][order]
        used, ends = np.unique(leaf[order], return_index=True)
        radii = np.maximum.reduceat(far, ends)
        to_leaf = distances(x[pivot][None], x[leaves[used]])[0]
        return {
            "dim": rows.shape[1], "radius": float(distances(x[pivot][None], x).max()), "pivot": rows[pivot].tobytes(), "leaf_pivots": rows[leaves[used]].tobytes(), "leaf_radii": radii.tobytes(), "leaf_far": to_leaf.tobytes(),
            "leaf_ends": np.append(ends[1:], len(x)).astype(np.int64).tobytes(), "ids": ids[order].tobytes(), "rows": rows[order].tobytes(), "far": far.tobytes(),
        }

    def __init__(self, most: float, **page: object) -> None:
        for name in ("leaf_radii", "leaf_far", "far"):
            setattr(self, name, np.frombuffer(page[name], np.float64))
        self.most, self.radius, dim = most, page["radius"], page["dim"]
        self.ends = np.frombuffer(page["leaf_ends"], np.int64)
        self.ids = np.frombuffer(page["ids"], np.int64)
        self.rows, self.leaf_pivots, self.pivot = (np.frombuffer(page[x], np.int64).reshape(-1, dim) for x in ("rows", "leaf_pivots", "pivot"))
        self.dense = self.rows.astype(np.float64)
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[np.lexsort((np.arange(len(self.ids)), self.ids))] = np.arange(len(self.ids))
        self.by_rank = self.ids[np.argsort(self.rank)]

    def search(self, ids: np.ndarray, rows: np.ndarray, need: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query's place, id, score) of the k best entries for each query with a score of at least `need`."""
        if self.most > EXACT:  # too large for exact doubles: every entry, in 64-bit integers
            for i, scores in enumerate(rows @ self.rows.T):
                some = np.flatnonzero((self.ids != ids[i]) & (scores >= need[i]))
                for j in some[np.lexsort((self.ids[some], -scores[some].astype(np.float64)))[:k]]:
                    yield i, int(self.ids[j]), int(scores[j])
            return
        q, need = rows.astype(np.float64), need.copy()
        base = (q * q).sum(axis=1) + self.most
        apart = lambda p: np.sqrt(np.maximum(0.0, base[:, None] - 2 * (q @ p.astype(np.float64).T)))
        bound = lambda d: (base[:, None] - np.maximum(0.0, d) ** 2) / 2 + 0.5
        to_page = apart(self.pivot)
        hopes = bound(np.maximum(np.abs(to_page - self.leaf_far[None]), 0) - self.leaf_radii[None])
        hopes[bound(to_page - self.radius)[:, 0] < need] = -np.inf
        open_leaves = np.flatnonzero((hopes >= need[:, None]).any(axis=0))
        to_leaf = apart(self.leaf_pivots[open_leaves])
        hopes = np.minimum(hopes[:, open_leaves], bound(to_leaf - self.leaf_radii[open_leaves][None]))
        best = np.full((len(q), k), LOW, np.int64)
        for at in np.argsort(-hopes.max(axis=0, initial=-np.inf), kind="stable"):  # best first
            who = np.flatnonzero(hopes[:, at] >= need)
            if not len(who):
                continue
            leaf = open_leaves[at]
            entries = np.arange(self.ends[leaf - 1] if leaf else 0, self.ends[leaf])
            close = bound(np.abs(to_leaf[:, at][:, None] - self.far[entries][None]))[who] >= need[who][:, None]
            entries = entries[close.any(axis=0)]
            if not len(entries):
                continue
            scores = (q[who] @ self.dense[entries].T).astype(np.int64)
            found = (scores << RANKS) - self.rank[entries][None]
            found[(self.ids[entries][None] == ids[who][:, None]) | (scores < need[who][:, None])] = LOW
            merged = np.concatenate([best[who], found], axis=1)
            best[who] = np.partition(merged, -k, axis=1)[:, -k:]
            least = best[who].min(axis=1)
            need[who] = np.maximum(need[who], np.where(least == LOW, -np.inf, ((least + (1 << RANKS) - 1) >> RANKS).astype(np.float64)))
        for i, j in zip(*np.nonzero(best != LOW), strict=True):
            rank = int(-best[i, j]) & ((1 << RANKS) - 1)
            yield int(i), int(self.by_rank[rank]), int(best[i, j] + rank) >> RANKS


def packed(rows: DataFrame, by: str, work: object, schema: str) -> DataFrame:
    """Calls work(key, ids, rows) for each group of rows (by, id, vec); groups have bounded sizes."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        now = None

        def done() -> pa.RecordBatch:
            out = work(now, np.array([x for x, _ in held], np.int64), np.frombuffer(b"".join(v for _, v in held), np.int64).reshape(len(held), -1))
            return pa.RecordBatch.from_pylist([out], schema=pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in schema.split(", "))]))

        for batch in batches:
            for key, i, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now and held:
                    yield done()
                    held = []
                now = key
                held.append((i, vec))
        if held:
            yield done()

    return rows.select(by, "id", "vec").repartition(by).sortWithinPartitions(by, "id").mapInArrow(stream, schema)


def met(pairs: DataFrame, index: DataFrame, blocks: DataFrame, most: float, k: int) -> DataFrame:
    """(block, place, vec_id, score): searches pages (key) for blocks of queries, one page after the other, its blocks streaming by."""
    salts = pairs.groupBy("key").agg(F.ceil(F.count("*") / F.lit(64.0)).cast("int").alias("salts"))
    pages = index.join(salts, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    asked = pairs.join(salts, "key").withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")).cast("int")).drop("salts").join(blocks.select("block", "dim", F.col("ids"), F.col("rows"), "need"), "block")
    both = pages.withColumns({"block": F.lit(None).cast("long"), "need": F.lit(None).cast("binary")}).unionByName(asked, allowMissingColumns=True)
    names = ["key", "salt", "block", "need", *Node.KINDS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, now = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}
                if row["block"] is None:
                    node, now = Node(most, **{n: row[n] for n in Node.KINDS}), (row["key"], row["salt"])
                    continue
                assert now == (row["key"], row["salt"])
                ids = np.frombuffer(row["ids"], np.int64)
                found = list(node.search(ids, np.frombuffer(row["rows"], np.int64).reshape(len(ids), -1), np.frombuffer(row["need"], np.float64), k))
                if found:
                    place, vec, score = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(found), pa.int64()), pa.array(place, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["block", "place", "vec_id", "score"])

    return both.select(names).repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("block").asc_nulls_first()).mapInArrow(work, "block long, place long, vec_id long, score long")


def admitted(blocks: DataFrame, index: DataFrame, most: float) -> DataFrame:
    """(block, key) of the pages that may hold an entry some query of the block needs, by routing object and covering radius; the home page is done."""
    groups = index.select("key", "dim", "pivot", "radius").withColumn("many", F.count("*").over(Window.partitionBy("dim")) / F.lit(float(FANOUT)))
    entries = groups.groupBy("dim", F.pmod(F.xxhash64("key"), F.ceil("many")).alias("node")).agg(F.collect_list(F.struct("key", "pivot", "radius")).alias("entries"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, home, rows, need, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                need = np.frombuffer(need, np.float64)
                q = np.frombuffer(rows, np.int64).reshape(len(need), -1).astype(np.float64)
                p = np.frombuffer(b"".join(x["pivot"] for x in entries), np.int64).reshape(len(entries), -1).astype(np.float64)
                base = (q * q).sum(axis=1)[:, None] + most
                least = np.maximum(0.0, np.sqrt(np.maximum(0.0, base - 2 * (q @ p.T))) - np.array([x["radius"] for x in entries])[None])
                keep = ((base - least**2) / 2 + 0.5 >= need[:, None]).any(axis=0) | (most > EXACT)
                keys = [x["key"] for x, ok in zip(entries, keep, strict=True) if ok and x["key"] != home]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(keys), pa.int64()), pa.array(keys, pa.int64())], names=["block", "key"])

    return blocks.join(entries, "dim").select("block", "home", "rows", "need", "entries").mapInArrow(work, "block long, key long")


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`, the k rows of highest inner product with it, exactly: query_id, rank, vec_id, score.

    Components are floor(scale * x). Ties go to the smaller id. Vectors are lifted onto a sphere, where the highest inner
    product is the least distance, and indexed in an M-tree: the root's routing objects (at most 256 vectors) deal the rows
    into cells, cells into pages of about 4096, pages into leaves of about 64 entries. Queries, in blocks, first search
    the page of their own cell, which gives the score they need; then only pages that the triangle inequality leaves open, in
    each the leaves best first. Stored distances from the parent spare most distance computations.

    Vectors that are null or empty or hold a null or non-finite component take no part. Vectors meet others of their
    length only. Rows with a query's id are its own; a null id is no query and comes last among ties; repeated ids give
    repeated answers with their own ranks. Scores beyond 2^48 are computed modulo 2^64, without pruning. Extra columns are not read.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "mtree")
    rows = tables.write(quantised(vectors, scale, id_col, vec_col), "rows")
    total, most = rows.agg(F.count("*"), F.max("norm")).first()
    most = most or 0.0
    sample = rows.groupBy(F.xxhash64("vec").alias("h")).agg(F.first("dim").alias("dim"), F.first("vec").alias("vec")).orderBy("h").limit(max(1, min(CELLS, total // (PAGE // 2)))).collect()
    routes: dict[int, np.ndarray] = {}
    for dim in {x.dim for x in sample}:
        routes[dim] = np.stack([np.frombuffer(x.vec, np.int64) for x in sample if x.dim == dim])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if int(dim) in routes:
                    x = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.int64).reshape(len(at), -1)
                    cell[at] = distances(lifted(x, most), lifted(routes[int(dim)], most)).argmin(axis=1)
                cell[at] += int(dim) << 10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell)], names=["id", "dim", "vec", "cell"])

    cells = tables.write(rows.select("id", "dim", "vec").mapInArrow(dealt, "id long, dim int, vec binary, cell long").withColumn("row", F.monotonically_increasing_id()), "cells")
    asked = (F.col("id") % every == 0) & (F.col("id") != LAST)
    sizes = tables.write(cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(PAGE))).alias("pages"), F.ceil(F.count(F.when(asked, 1)) / F.lit(float(BLOCK))).alias("blocks")), "sizes")
    placed = cells.join(sizes, "cell")
    keyed = placed.withColumn("key", F.shiftleft("cell", 24) + F.pmod(F.xxhash64("row"), F.col("pages")))
    build = lambda key, ids, vecs: {"key": key} | Node.build(ids, vecs, most)
    index = tables.write(packed(keyed, "key", build, "key long, " + ", ".join(f"{n} {t}" for n, t in Node.KINDS.items())), "index")
    grouped = placed.filter(asked).withColumn("block", F.shiftleft("cell", 24) + F.pmod(F.xxhash64("row"), F.col("blocks")))
    pack = lambda key, ids, vecs: {"block": key, "dim": vecs.shape[1], "ids": ids.tobytes(), "rows": vecs.tobytes(), "need": np.full(len(ids), -np.inf).tobytes()}
    blocks = tables.write(packed(grouped, "block", pack, "block long, dim int, ids binary, rows binary, need binary").withColumn("home", F.shiftleft(F.shiftright("block", 24), 24)), "blocks")
    near = tables.write(met(blocks.select("block", F.col("home").alias("key")), index, blocks, most, k), "near")
    needs = near.groupBy("block", "place").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k).groupBy("block").agg(F.collect_list(F.struct("place", "score")).alias("known"))

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = []
            for old, known in zip(batch.column("need").to_pylist(), batch.column("known").to_pylist(), strict=True):
                new = np.frombuffer(old, np.float64).copy()
                for x in known or []:
                    new[x["place"]] = x["score"]
                need.append(new.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("block", "dim", "ids", "rows", "home")), pa.array(need, pa.binary())], names=["block", "dim", "ids", "rows", "home", "need"])

    blocks = tables.write(blocks.join(needs, "block", "left").mapInArrow(raised, "block long, dim int, ids binary, rows binary, home long, need binary"), "raised")
    pairs = tables.write(admitted(blocks, index, most), "pairs")
    far = met(pairs, index, blocks, most, k)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), pa.array(ids)], names=["block", "place", "query_id"])

    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = near.union(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    queries = blocks.select("block", "ids").mapInArrow(named, "block long, place long, query_id long")
    out = tables.write(ranked.join(queries, ["block", "place"]).select("query_id", "rank", F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("vec_id"), "score"), "top")
    for part in ("rows", "cells", "sizes", "index", "blocks", "near", "raised", "pairs"):
        tables.drop(part)
    return out


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select query_id, cast(n as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s) where n <= 20
"""
