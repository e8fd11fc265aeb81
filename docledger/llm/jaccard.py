"""Similarity join of documents on the Jaccard coefficient of word n-grams, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm._spark import Tables, byte_blocks
from docledger.llm.suffix import BASE, constants, mixed, powers

BLOCK = 1 << 19
SLOTS = 1 << 21
PARTS = 32
COLUMNS = 256
PER_HUB = 64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Hashes of the words (runs of other than ASCII white space, A-Z in lower case) and word n-grams of texts."""

    breaks = SPACE

    def __init__(self, k: int) -> None:
        self.k = k
        self.table, inverse = constants()
        self.inverse = inverse
        self.up, self.down = powers(BASE, 2 * BLOCK), powers(inverse, 2 * BLOCK)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places within runs at which a word ends and the next begins."""
        return np.zeros(0, np.int64)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, place where it starts, where it ends, and for each text the number of words before it), as texts stand one after the other."""
        if not len(data):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
        inside = ~self.breaks[data]
        edge = np.empty(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[:1], edge[-1:] = inside[:1], inside[-1:]
        bounds = np.concatenate([offsets[1:-1], self.cuts(data)])
        bounds = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
        glued = bounds[inside[bounds] & inside[bounds - 1]]  # a word ends with its text
        edge[glued] = False
        places = np.flatnonzero(edge)
        starts, ends = places[::2], places[1::2]
        if len(glued):
            starts, ends = np.sort(np.concatenate([starts, glued])), np.sort(np.concatenate([ends, glued]))
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # so many words at a time as the powers reach; a longer word by itself
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + len(self.up), side="right")))
            a, b = starts[at], ends[to - 1]
            up, down = (self.up, self.down) if b - a <= len(self.up) else (powers(BASE, b - a), powers(self.inverse, 1))
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.table[LOWER[data[a:b]]] * up[: b - a], out=sums[1:])
            s, e = starts[at:to] - a, ends[at:to] - a
            out[at:to] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            at = to
        return out, starts, ends, np.searchsorted(starts, offsets)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Of each text the distinct hashes of its n-grams, sorted; a text of fewer words has one for all its words."""
        words, _, _, begin = self.hashes(data, offsets)
        grams = np.zeros(max(0, len(words) - self.k + 1), np.uint64)
        for i in range(self.k):
            grams = grams * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + len(grams)]
        grams = mixed(grams)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if b - a >= self.k:
                yield np.unique(grams[a : b - self.k + 1])
            elif b > a:
                whole = b - a
                for w in words[a:b].tolist():
                    whole = (whole * 0x9FB21C651E98DF25 + w) % (1 << 64)
                yield mixed(np.array([whole], np.uint64))
            else:
                yield words[:0]


def column_ranks(texts: DataFrame, k: int) -> np.ndarray:
    """How frequent an n-gram is, roughly, by a hash of it: a sketch of fixed size over all documents (2 MiB).

    It only orders the n-grams, rare ones first. The join is exact for any order; this one keeps frequent n-grams out of
    the prefixes by which documents meet.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(k), np.zeros(SLOTS, np.int32)
        for _, data, offsets in byte_blocks(batches, "text", BLOCK):
            np.add.at(counts, (np.concatenate(list(words.sets(data, offsets))) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        for i, part in enumerate(counts.reshape(PARTS, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts.as_py(), np.int32).astype(np.int64)
        for part, counts in total.items():
            rank = np.minimum(255, 8 * np.log2(np.maximum(1, counts))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rank.tobytes()], pa.binary())], names=["part", "ranks"])

    rows = texts.mapInArrow(counted, "part int, counts binary").repartition("part").mapInArrow(added, "part int, ranks binary").collect()
    ranks = np.zeros((PARTS, SLOTS // PARTS), np.uint8)
    for row in rows:
        ranks[row.part] = np.frombuffer(row.ranks, np.uint8)
    return ranks.ravel()


def least_overlap(n: Column, m: Column, num: int, den: int) -> Column:
    """den * i >= num * (n + m - i), solved for i."""
    return F.ceil((F.lit(num) * (n + m)) / F.lit(float(num + den)))


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, component) of undirected edges (a, b), the component being its least node; alternating large and small stars."""
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = tables.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}0")
    seen, turn = state(now), 0
    while True:
        turn += 1
        wide = both(now)
        large = wide.join(least(wide), F.col("a") == F.col("u")).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(least(large), F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        new = tables.write(small, f"{name}{turn}")
        tables.drop(f"{name}{turn - 1}")
        now, before, seen = new, seen, state(new)
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()


def likely(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs of nodes (a, b) those whose overlap may reach its least value, judged by the block sums of their incidence rows.

    The n-grams fall into 256 column blocks; the sum over blocks of the smaller count bounds the overlap from above.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, left, right = batch.columns
            n, m = n.to_numpy(), m.to_numpy()
            keep = np.ones(len(n), bool)
            known = np.flatnonzero([x and y for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)])
            if len(known):
                x, y = (np.frombuffer(b"".join(c.take(pa.array(known)).to_pylist()), np.uint8).reshape(-1, COLUMNS) for c in (left, right))
                keep[known] = np.minimum(x, y).sum(axis=1, dtype=np.int64) * (num + den) >= num * (n[known] + m[known])
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    sums = reps.select("node", "n", "sums")
    joined = (
        pairs.join(sums.withColumnsRenamed({"node": "a", "n": "na", "sums": "sa"}), "a")
        .join(sums.withColumnsRenamed({"node": "b", "n": "nb", "sums": "sb"}), "b")
        .filter((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num))
        .select("a", "b", "na", "nb", "sa", "sb")
    )
    return joined.mapInArrow(judged, "a long, b long")


def linked(pairs: DataFrame, texts: DataFrame, reps: DataFrame, tables: Tables, name: str, k: int, num: int, den: int) -> DataFrame:
    """Of pairs of nodes (a, b) those whose Jaccard coefficient is num / den or more.

    Rows of the incidence matrix are read again for the nodes in likely pairs only. The product is made in blocks: one
    row (b) times the rows of about 64 others, whose common columns are counted.
    """
    pairs = tables.write(likely(pairs, reps, num, den), f"{name}-likely")
    wanted = reps.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi").select("node", "doc", "version")
    wanted = tables.write(wanted, f"{name}-wanted")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(k)
        for part, data, offsets in byte_blocks(batches, "text", BLOCK):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in words.sets(data, offsets)], pa.binary())], names=["node", "row"])

    match = texts["doc"].eqNullSafe(wanted["doc"]) & (texts["version"] == wanted["version"])
    incidence = texts.join(wanted, match).select("node", "text").mapInArrow(rows, "node long, row binary")
    incidence = tables.write(incidence, f"{name}-rows")
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(float(PER_HUB))).cast("int").alias("blocks"))
    others = pairs.join(blocks, "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).join(incidence.withColumnRenamed("node", "a"), "a").select("b", "block", "a", "row")
    own = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(incidence.withColumnRenamed("node", "b"), "b").select("b", "block", F.lit(None).cast("long").alias("a"), "row")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            held: list[tuple[int, np.ndarray]] = []

            def done(held: list, base: np.ndarray, hub: int, found: list) -> None:
                if not held:
                    return
                values = np.concatenate([x for _, x in held])
                place = np.minimum(np.searchsorted(base, values), len(base) - 1)
                sizes = np.array([len(x) for _, x in held])
                overlap = np.add.reduceat(base[place] == values, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
                ok = overlap * (num + den) >= num * (sizes + len(base))
                found += [(node, hub) for (node, _), o in zip(held, ok, strict=True) if o]

            for hub, block, a, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a is None:
                    done(held, base, at and at[0], found)
                    held, at, base = [], (hub, block), np.frombuffer(row, np.uint64)
                else:
                    assert at == (hub, block)
                    held.append((a, np.frombuffer(row, np.uint64)))
            done(held, base, at and at[0], found)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    out = others.unionByName(own).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first()).mapInArrow(product, "a long, b long")
    out = tables.write(out, f"{name}-links")
    for part in ("likely", "wanted", "rows"):
        tables.drop(f"{name}-{part}")
    return out


def joined(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, n, row, first) of each row, `first` being the least (doc, row) of its component; see `similar`."""
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard")
    version = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("doc"), version.alias("version"), F.col(text_col).alias("text"))
    ranks = spark.sparkContext.broadcast(column_ranks(texts.select("text"), k))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rank = Words(k), ranks.value
        for rows, data, offsets in byte_blocks(batches, "text", BLOCK):
            out: list[tuple] = []
            for own in words.sets(data, offsets):
                n = len(own)
                order = np.argsort(rank[(own & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")[: n + -n * num // den + 1 if n else 0]
                sums = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=COLUMNS)
                one, two = mixed(own).sum(dtype=np.uint64), mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                out.append((n, one.astype(np.int64), two.astype(np.int64), own[order].view(np.int64), sums.astype(np.uint8).tobytes() if sums.max() < 255 else b""))
            n, one, two, prefix, sums = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sums, pa.binary())], names=["doc", "version", "n", "one", "two", "prefix", "sums"])

    schema = T.StructType([texts.schema["doc"], *T._parse_datatype_string("version long, n long, one long, two long, prefix array<long>, sums binary").fields])
    sets = tables.write(texts.mapInArrow(measured, schema).withColumn("row", F.monotonically_increasing_id()), "sets")
    nodes = sets.filter("n > 0").groupBy("n", "one", "two").agg(F.min("row").alias("node"), F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "row")).alias("first"))
    nodes = tables.write(nodes, "nodes")
    reps = tables.write(sets.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "doc", "version", "n", "prefix", "sums"), "reps")
    columns = reps.select("node", "n", F.posexplode("prefix").alias("place", "column"))
    hubs = columns.groupBy("column").agg(F.min(F.struct("place", "node", "n")).alias("hub"), F.count("*").alias("rows")).filter("rows > 1")
    hubs = tables.write(hubs.select("column", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.place").alias("hub_place"), "rows"), "hubs")

    def fits(n: Column, place: Column, m: Column, other: Column) -> Column:
        return (F.least(n - place, m - other) >= least_overlap(n, m, num, den)) & (n * den >= m * num) & (m * den >= n * num)

    shared = columns.join(hubs, "column")
    starry = shared.filter((F.col("node") != F.col("hub")) & fits(F.col("n"), F.col("place"), F.col("hub_n"), F.col("hub_place"))).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = linked(starry, texts, reps, tables, "star", k, num, den)
    stars = components(links, tables, "stars")
    rest = shared.filter("rows > 2").select("column", "node", "n", "place").join(stars, "node", "left").select("column", "node", "n", "place", F.coalesce("component", "node").alias("component"))
    # of columns whose rows are all in one component nothing is left to join
    several = rest.groupBy("column").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("column")
    rest = tables.write(rest.join(several, "column", "left_semi"), "rest")
    left, right = rest.alias("l"), rest.alias("r")
    pairs = (
        left.join(right, F.col("l.column") == F.col("r.column"))
        .filter((F.col("l.component") != F.col("r.component")) & (F.col("l.node") > F.col("r.node")) & fits(F.col("l.n"), F.col("l.place"), F.col("r.n"), F.col("r.place")))
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    )
    more = linked(pairs, texts, reps, tables, "rest", k, num, den)
    whole = components(links.unionByName(more), tables, "whole")
    named = nodes.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("first").alias("least"))
    by_set = tables.write(named.join(firsts, "component").select("n", "one", "two", "least"), "components")
    for part in ("reps", "hubs", "rest", "nodes", "star-links", "rest-links"):
        tables.drop(part)
    own = F.struct(F.col("doc").isNull().alias("last"), "doc", "row")
    return sets.select("doc", "version", "n", "one", "two", "row").join(by_set, ["n", "one", "two"], "left").select("doc", "version", "n", "row", F.coalesce("least", own).alias("first"))


def similar(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose sets of word n-grams have a Jaccard coefficient of num / den or more.

    Returns id, n_shingles (size of the set), component_id (least id that links reach, the document itself included).
    Words are runs of other than ASCII white space with A-Z in lower case; a text of fewer than k words has one n-gram
    of all its words; a null text or one without words has none and links with nothing. Rows with the same set form one
    node. Equal ids with different texts are separate documents. Other columns are not read.

    1. Each document's incidence row is ordered by rarity; any two rows that link share a column in their prefixes of
       n - ceil(n * num / den) + 1, at places that leave enough columns behind. Only prefixes are shuffled.
    2. Each row is multiplied with one hub for each column of its prefix: the row in which that column comes first. In groups
       of copies this links nearly all rows, in as many products as there are rows, and not all pairs.
    3. What is left are pairs that share a prefix column and are not yet in one component; they are all multiplied, so
       the components are exact.
    """
    out = joined(docs, k, num, den, id_col, text_col)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.doc").alias("component_id"))


def distinct(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near copies: of each component of `similar`, the document of least id stays.

    A text without words is like no other and stays. Rows equal in id and text are one document, of which one row stays.
    """
    found = joined(docs, k, num, den, id_col, text_col)
    kept = found.filter(F.col("row") == F.col("first.row")).select(F.col("doc").alias("kept_doc"), F.col("version").alias("kept_version"), (F.col("n") == 0).alias("kept_empty"))
    kept = Tables(docs.sparkSession, "distinct").write(kept, "kept").dropDuplicates(["kept_doc", "kept_version"])
    version = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumn("kept_row", version).join(kept, F.col(id_col).eqNullSafe(F.col("kept_doc")) & (F.col("kept_row") == F.col("kept_version")))
    turn = Window.partitionBy("kept_doc", "kept_version").orderBy("kept_version")
    return rows.withColumn("kept_turn", F.row_number().over(turn)).filter("kept_empty or kept_turn = 1").select(*(docs[c] for c in docs.columns))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] end as g
  from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
reach as (select a as doc_id, a as other from e union select r.doc_id, e.b from reach r join e on r.other = e.a),
c as (select doc_id, min(other) as least from reach group by doc_id)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(least, w.doc_id) as component_id from w left join n using (doc_id) left join c using (doc_id)
"""
