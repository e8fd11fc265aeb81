"""A Merkle manifest of a dataset: one digest for all rows, and for each row the proof that it is part of it.

Rows are sorted into ranges over all tasks. Each partition turns its leaves into a sparse forest: the nodes whose run of
siblings is not complete there, keyed by tree, level and index. Forests merge associatively, as the size of each tree tells
how many nodes each run has: whenever a run is complete it is replaced by its parent. `treeReduce` merges the partitions'
forests to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm._spark import Ranges, Tables, runs

ARITY = 8
#: So many nodes above the blocks stay at most (and one for each group): some 100 bytes each, they go to all tasks.
UPPER = 1 << 17
LEAST_BLOCK = 3  # levels
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the groups' roots.
TOP = -1


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def encoded(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows are written alike; `-` if null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def height(nodes: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


@dataclass
class Forest:
    """Nodes (tree, level, index) whose siblings are not all known, and of the merged ones those that are kept.

    Trees are numbered by group; their roots are the leaves of the tree TOP.
    """

    open: dict = field(default_factory=dict)
    kept: dict = field(default_factory=dict)


@dataclass
class Shape:
    """The number of leaves of each tree, and from which level its nodes are kept."""

    sizes: list[int]
    keep: int

    def count(self, tree: int, level: int) -> int:
        nodes = len(self.sizes) if tree == TOP else self.sizes[tree]
        for _ in range(level):
            nodes = -(-nodes // ARITY)
        return nodes

    def run(self, key: tuple[int, int, int]) -> list[tuple[int, int, int]]:
        """The node and its siblings."""
        tree, level, index = key
        first = index // ARITY * ARITY
        return [(tree, level, i) for i in range(first, min(first + ARITY, self.count(tree, level)))]

    def add(self, forest: Forest, nodes: dict) -> Forest:
        """The forest with further nodes, complete runs replaced by their parents as far up as it goes."""
        todo = list(nodes)
        forest.open.update(nodes)
        while todo:
            key = todo.pop()
            tree, level, index = key
            if key not in forest.open:
                continue
            if self.count(tree, level) == 1:  # a root: a leaf of the tree above
                if tree == TOP:
                    continue
                parent, own = (TOP, 0, tree), [key]
            else:
                parent, own = (tree, level + 1, index // ARITY), self.run(key)
                if not all(k in forest.open for k in own):
                    continue
            found = [forest.open.pop(k) for k in own]
            forest.open[parent] = found[0] if parent[:2] == (TOP, 0) else digest(b"".join(found))
            forest.kept.update((k, d) for k, d in zip(own, found, strict=True) if tree == TOP or level >= self.keep)
            todo.append(parent)
        return forest

    def merge(self, one: Forest, other: Forest) -> Forest:
        one.kept.update(other.kept)
        return self.add(one, other.open)

    def siblings(self, kept: dict, key: tuple[int, int, int]) -> Iterator[tuple[bytes, bytes]]:
        """From a kept node to the root, what stands left and right of it."""
        tree, level, index = key
        while True:
            if self.count(tree, level) == 1:
                if tree == TOP:
                    return
                tree, level, index = TOP, 0, tree
                continue
            own = [(k[2], kept[k]) for k in self.run((tree, level, index)) if k[2] != index]
            yield b"".join(d for i, d in own if i < index), b"".join(d for i, d in own if i > index)
            level, index = level + 1, index // ARITY


def levels(leaves: list[bytes], most: int) -> list[list[bytes]]:
    """Of a block's leaves, for each level the digests of each run, joined; at most so many levels, the block's root apart."""
    out = []
    for _ in range(most):
        out.append([b"".join(leaves[i : i + ARITY]) for i in range(0, len(leaves), ARITY)])
        leaves = [digest(run) for run in out[-1]]
    return out


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group: str = "lang", changed: dict[str, Column] | None = None, where: Column | None = None, siblings: bool = False) -> DataFrame:
    """Digests, roots and checked proofs of all rows.

    A leaf is the sha256 (lowercase hex, as all digests) of a row's columns. Per group, leaves ascend by id; while there
    are several nodes, each eight consecutive ones become the digest of theirs joined. The groups' roots, ordered by
    group, give the root alike. Each proof is folded from the row's leaf, or, where `where` holds, from the leaf of the row
    with `changed` columns, to see whether it gives the root. Returns the id, leaf, subroot, root, proof_sha256 (the digest
    of all siblings from the leaf to the root), folded_root, verified, n_siblings, and with `siblings` the proof itself: on
    each level what stands left and right.

    Nulls are values of their own: null groups come first, and so do null ids. Rows of equal id are ordered by their leaves;
    equal rows have leaves of their own. An empty table gives no rows. Extra columns are not read.

    The driver holds one count for each partition and group, and at most UPPER nodes and one for each group. Proofs are
    made in blocks of 8^k consecutive leaves of a group, each with the path above it; k grows with the table.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    tables = Tables(spark, "merkle")
    values = lambda new: [new.get(c, F.col(c)) for c in columns]
    other = F.when(where, F.unhex(leaf(values(changed)))) if changed and where is not None else F.lit(None).cast("binary")
    own = docs.select(F.col(id_col).alias("id"), F.col(group).cast("string").alias("of"), F.unhex(leaf(values({}))).alias("leaf"), other.alias("other"))
    # the number of a row spreads equal rows over ranges; their leaves are equal, so that their order does not matter
    ranges = Ranges(tables.write(own, "leaves").withColumn("row", F.monotonically_increasing_id()), "of", "id", "leaf", "row")
    tables.drop()
    # Spark sorts strings by their bytes, nulls first; so the trees are numbered
    order = sorted(ranges.totals, key=lambda x: (x is not None, (x or "").encode()))
    number = {of: i for i, of in enumerate(order)}
    sizes = [ranges.totals[of] for of in order]
    keep = LEAST_BLOCK
    while sum(sizes) > UPPER * ARITY**keep:
        keep += 1
    shape, before = Shape(sizes, keep), ranges.before

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
        """Runs of one group, with its tree and the place of their first leaf."""
        at = dict(before.get(TaskContext.get().partitionId(), {}))
        for batch in batches:
            names = batch.column("of").to_pylist()
            for start, end in runs(names):
                of = names[start]
                yield batch.slice(start, end - start), number[of], at[of]
                at[of] += end - start

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Forest()
        for batch, tree, first in placed(batches):
            shape.add(found, {(tree, 0, first + i): d.hex().encode() for i, d in enumerate(batch.column("leaf").to_pylist())})
        for is_open, nodes in ((True, found.open), (False, found.kept)):
            if nodes:
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in nodes], pa.int64()) for i in range(3)), pa.array(list(nodes.values()), pa.binary()), pa.array([is_open] * len(nodes))], names=["tree", "level", "index", "digest", "open"])

    def gathered(rows: Iterator) -> Iterator[Forest]:
        found = Forest()
        for tree, level, index, data, is_open in rows:
            (found.open if is_open else found.kept)[tree, level, index] = bytes(data)
        yield found

    out = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_siblings int" + (", proof array<struct<left:string,right:string>>" if siblings else "")
    if not sizes:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    whole = ranges.rows.select("of", "leaf").mapInArrow(forest, "tree long, level long, index long, digest binary, open boolean").rdd.mapPartitions(gathered).treeReduce(shape.merge)
    ((_, root),) = whole.open.items()
    kept, block = whole.kept, ARITY**keep

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tree, first in placed(batches):
            place = range(first, first + batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("leaf"), batch.column("other"), pa.array([tree] * len(place), pa.int64()), pa.array([i // block for i in place], pa.int64()), pa.array([i % block for i in place], pa.int64())], names=["id", "leaf", "other", "tree", "block", "place"])

    def proofs(tree: int, at: int, leaves: list[bytes], others: list[bytes | None]) -> list[tuple]:
        inside = min(keep, height(sizes[tree]))
        under = levels(leaves, inside)
        above = list(shape.siblings(kept, (tree, inside, at)))
        end = b"".join(a + b for a, b in above)
        subroot = kept.get((TOP, 0, tree), root).decode()
        rows = []
        for i, own in enumerate(leaves):
            parts, node, place = [], others[i] or own, i
            path = []
            for level in under:
                run, at_byte = level[place // ARITY], place % ARITY * 64
                left, right = run[:at_byte], run[at_byte + 64 :]
                parts += (left, right)
                node, place = digest(left + node + right), place // ARITY
                path.append((left, right))
            for left, right in above:
                node = digest(left + node + right)
            proof = b"".join(parts) + end
            rows.append((own.decode(), subroot, root.decode(), hashlib.sha256(proof).hexdigest(), node.decode(), node == root, len(proof) // 64, *([[{"left": a.decode(), "right": b.decode()} for a, b in (*path, *above)]] if siblings else [])))
        return rows

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            hexed = lambda c: [d and d.hex().encode() for d in rows.column(c).to_pylist()]
            made = proofs(rows.column("tree")[0].as_py(), rows.column("block")[0].as_py(), hexed("leaf"), hexed("other"))
            kinds = [*[pa.string()] * 5, pa.bool_(), pa.int32(), *([pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))] if siblings else [])]
            names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings", *(["proof"] if siblings else [])]
            return pa.RecordBatch.from_arrays([rows.column("id"), *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names=names)

        last = None
        for batch in batches:
            keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
            for start, end in runs(keys):
                if waiting and keys[start] != last:
                    yield block_of(waiting)
                    waiting = []
                last = keys[start]
                waiting.append(batch.slice(start, end - start))
        if waiting:
            yield block_of(waiting)

    rows = ranges.rows.drop("row").mapInArrow(numbered, f"id {kind}, leaf binary, other binary, tree long, block long, place long")
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").mapInArrow(prove, out).withColumnRenamed("id", id_col)


def _encoded(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_encoded(c if c != 'text' else text) for c in COLUMNS)})"


UPPERCASE = "".join(map(chr, range(65, 91)))
#: crc32 bit by bit, as DuckDB has none.
CRC = "xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint), lambda c, b: list_reduce([0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, xor(c, b)), 4294967295::bigint), 4294967295)"

SQL = f"""
with recursive leaves as (
  select row_number() over () as k, doc_id, dense_rank() over (order by lang nulls first) - 1 as g, {_leaf('text')} as leaf,
    case when doc_id is not null and ({CRC}) % 3 = 0 then {_leaf(f"translate(text, '{UPPERCASE}', '{UPPERCASE.lower()}')")} end as other from documents),
ordered as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from leaves),
trees as (
  select g, 0 as level, i, leaf as h, n from ordered
  union all
  select g, level + 1, i // 8, sha256(string_agg(h, '' order by i)), (any_value(n) + 7) // 8 from trees where n > 1 group by g, level, i // 8),
tops as (
  select 0 as level, g as i, h, count(*) over () as n from trees where n = 1
  union all
  select level + 1, i // 8, sha256(string_agg(h, '' order by i)), (any_value(n) + 7) // 8 from tops where n > 1 group by level, i // 8),
sides as (
  select g, level, i, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as r
  from (select g, level, i, h from trees where n > 1 union all select -1, level, i, h from tops where n > 1) window w as (partition by g, level, i // 8 order by i)),
steps as (
  select o.k, s.level + 100 * (s.g = -1)::integer as place, s.l, s.r from ordered o join sides s on (s.g = o.g and s.i = o.i // cast(pow(8, s.level) as bigint)) or (s.g = -1 and s.i = o.g // cast(pow(8, s.level) as bigint))),
numbered as (select *, row_number() over (partition by k order by place) as turn from steps),
folded as (
  select k, 0 as turn, coalesce(other, leaf) as h from ordered
  union all
  select f.k, f.turn + 1, sha256(s.l || f.h || s.r) from folded f join numbered s on s.k = f.k and s.turn = f.turn + 1),
proofs as (select k, sha256(string_agg(l || r, '' order by place)) as proof from steps group by 1),
root as (select h from tops where n = 1),
ends as (select k, arg_max(h, turn) as h from folded group by 1)
select o.doc_id, o.leaf, t.h as subroot, (select h from root) as root, coalesce(p.proof, sha256('')) as proof_sha256, e.h as folded_root, e.h = (select h from root) as verified
from ordered o join trees t on t.g = o.g and t.n = 1 join ends e on e.k = o.k left join proofs p on p.k = o.k
"""
