"""Whitening, Merkle manifests and packing against plain versions, on awkward rows and small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docledger.llm import merkle, packing, whitening
from docledger.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain_whitening(rows, components=4):
    """(id, component) -> (n, deviation, whitened up to its sign, explained)."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    if not width:
        return {}
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = defaultdict(list)
    for i, x in kept:
        own = np.array([float(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        for k in range(min(components, width)):
            e, v = values[-1 - k], vectors[:, -1 - k]
            white = abs(own @ v) / math.sqrt(e) if e > values.sum() * width * np.finfo(float).eps else None
            out[i, k + 1].append((n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), white, e / values.sum() if values.sum() > 0 else None))
    return out


def same_whitening(got, want):
    assert Counter((r.vec_id, r.component) for r in got) == Counter({k: len(v) for k, v in want.items()})
    left = {k: list(v) for k, v in want.items()}
    near = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-6 * max(1, abs(b)))
    for r in got:
        rows = left[r.vec_id, r.component]
        match = next(x for x in rows if x[:2] == (r.n, int(r.deviation)) and near(None if r.whitened is None else abs(r.whitened), x[2]) and near(r.explained, x[3]))
        rows.remove(match)
        assert r.identity_error is None or r.identity_error < 1e-6


@pytest.mark.parametrize("tile", [32, 7])
def test_whitening_brute(spark, tile):
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    same_whitening(whitening.whiten(frame, tile=tile).collect(), plain_whitening([(r.vec_id, r.embedding) for r in frame.collect()]))


def test_whitening_awkward(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) + 1000 for _ in range(5)]) for i in range(60)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (None, [1.0, 2.0, 3.0, 4.0, 5.0]), (70, None), (71, []), (72, [1.0, None, 2.0]), (73, [float("nan")] * 5), (74, [float("inf")] + [0.0] * 4), (75, [3.0, 4.0]), (76, [-0.001] * 5), *((80, [9.0] * 5) for _ in range(50))]
    frame = plain.clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    same_whitening(whitening.whiten(frame, tile=2).collect(), plain_whitening(rows))
    signs = {(r.vec_id, r.component, r.whitened) for r in whitening.whiten(frame, tile=2).collect() if r.vec_id == 0}
    assert len(signs) == 4  # one sign for all rows of a component


def test_whitening_small(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3, kind)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, None, None) for _ in range(3) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(9)], kind)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and {round(r.explained, 9) for r in line if r.component == 1} == {1.0}


def test_whitening_exact(spark):
    """Sums and deviations of values far beyond 64 bits stay whole numbers."""
    rows = [(i, [2.0**45 * (i + 1), float(i)]) for i in range(7)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = plain_whitening(rows)
    assert {(r.vec_id, int(r.deviation)) for r in got.collect() if r.component == 1} == {(i, v[0][1]) for (i, c), v in want.items() if c == 1}
    assert {r.vec_id: r.d is None for r in got.select("vec_id", F.col("deviation").try_cast("long").alias("d")).collect()} == {i: v[0][1] >= 1 << 63 for (i, _), v in want.items()}


def plain_manifest(rows, changed):
    """(doc_id, leaf) -> (subroot, root, proof_sha256, folded_root), by building whole trees."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    coded = lambda row: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def path(levels, i):
        for level in levels[:-1]:
            run, at = level[i // 8 * 8 : i // 8 * 8 + 8], i % 8
            yield "".join(run[:at]), "".join(run[at + 1 :])
            i //= 8

    groups = defaultdict(list)
    for row in rows:
        doc, source, lang, n, text = row
        groups[lang].append((doc is not None, doc or 0, coded(row), coded((doc, source, lang, n, changed(doc, text))), doc))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, own, other, doc) in enumerate(sorted(groups[g])):
            sides = [*path(trees[g], i), *path(top, k)]
            node = other
            for left, right in sides:
                node = h(left + node + right)
            out.append((doc, own, trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in sides)), node, node == top[-1][0]))
    return out


def lowered(doc, text):
    return text.translate(plain.LOWER) if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else text


def manifest_rows(frame):
    upper = "".join(map(chr, range(65, 91)))
    done = merkle.manifest(frame, changed={"text": F.translate("text", upper, upper.lower())}, where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("upper", [1 << 17, 1])
def test_manifest_brute(spark, monkeypatch, upper):
    monkeypatch.setattr(merkle, "UPPER", upper)
    rng = random.Random(2)
    many = [(rng.choice([None, *range(900)]), rng.choice([None, "s", "Ä"]), rng.choice([None, "en", "en", "en", "de", "", "é", "\U0001f600", "�"]), rng.choice([None, 3]), rng.choice([None, "", "Ab", "ÉA", "x" * 3000])) for _ in range(1500)]
    for rows in (many, many[:9], [*many[:3], *many[:3]], [(i, "s", "en", 1, "T") for i in range(65)], [(i, "s", f"l{i:03}", 1, "T") for i in range(70)], [(1, "s", "en", 1, "T")], [(7, "s", "en", 1, "T")] * 600):
        frame = spark.createDataFrame([(a, e, c, b, d) for a, b, c, d, e in rows], DOCS)
        got = [tuple(r) for r in manifest_rows(plain.clashing(frame)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(rows, lowered)))
    assert manifest_rows(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_proofs(spark):
    """Proofs alone are enough to check a row; any other leaf fails."""
    rows = merkle.manifest(spark.read.parquet(f"{SMALL}/documents.parquet"), siblings=True).collect()
    for r in rows:
        for start, good in ((r.leaf, True), (r.leaf[::-1], False)):
            for side in r.proof:
                start = hashlib.sha256((side.left + start + side.right).encode()).hexdigest()
            assert (start == r.root) == good
    assert all(r.verified and r.n_siblings == sum(len(p.left) + len(p.right) for p in r.proof) // 64 for r in rows)


def test_forest():
    """Forests merge to the same root in whatever order."""
    shape = merkle.Shape([1, 8, 77, 1000], 3)
    rng = random.Random(4)
    leaves = {(t, 0, i): hashlib.sha256(f"{t}-{i}".encode()).hexdigest().encode() for t, n in enumerate(shape.sizes) for i in range(n)}
    roots = set()
    for parts in (1, 3, 40):
        shares = [{} for _ in range(parts)]
        for k, d in leaves.items():
            rng.choice(shares)[k] = d
        forests = [shape.add(merkle.Forest(), own) for own in shares]
        while len(forests) > 1:
            rng.shuffle(forests)
            forests.append(shape.merge(forests.pop(), forests.pop()))
        ((key, root),) = forests[0].open.items()
        assert key == (merkle.TOP, 1, 0)
        roots.add(root)
    assert len(roots) == 1


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in range(len(rooms)) if rooms[r] >= n), key=lambda r: rooms[r], default=None)
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms[best] -= n
    return rooms


def test_best_fit():
    """The same gaps are left as by best-fit decreasing one document at a time, and every document has a place of its own."""
    rng = random.Random(6)
    for capacity in (1, 10, 37, 100):
        for size in (0, 1, 5, 60, 400):
            lengths = [rng.choice([rng.randint(1, capacity), 1, capacity]) for _ in range(size)]
            moves, opened = packing.best_fit(dict(Counter(lengths)), capacity)
            want = plain_best_fit(lengths, capacity)
            held, seen = defaultdict(list), defaultdict(set)
            for length, rank, each, n, first, offset in moves.tolist():
                for i in range(n):
                    for u in range(each):
                        seen[length].add(rank + i * each + u)
                        held[first + i].append((offset + u * length, length))
            assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
            left = []
            for own in held.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                left.append(capacity - at)
            assert sorted(left) == sorted(want) and len(held) == opened == len(want)


def check_packing(rows, want, capacity):
    """Every piece is there once with its ids, and sequences are filled from 0 without gaps, within the capacity."""
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def plain_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    out = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            out[doc, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    return out


def test_packing_brute(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain_pieces(rows, 4096)
    assert check_packing(QUERIES["op13_best_fit"](spark, SMALL).collect(), want, 4096) == len(plain_best_fit([k[3] for k in want.elements()], 4096))


def test_packing_awkward(spark):
    odd = ["Don't STOP 42 it's", "a\x1cb\x0bc\x85d　e\xa0f", "Ünï çödé Straße ΣΑΣ İI", "x́ é̂ ́", "<|endoftext|> <|startoftext|>x", "日本語 テキスト", "\U0001f600\U0001f600 ok", "a" * 5000, "tab\tnew\nline\r\n", "'s 's'S can'T", "\x00\x01", "½ ² Ⅷ ٣", "word " * 3000, " x﻿y​z", "ÅΩ ﬁ"]
    rows = [*enumerate(odd), (3, odd[3]), (3, odd[3]), (None, "no id"), (None, None), (99, None), (100, ""), *((200, "copy of one text") for _ in range(300))]
    frame = plain.clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    for capacity in (64, 7):
        want = plain_pieces(rows, capacity)
        assert check_packing(packing.pack_documents(frame, VOCABULARY, capacity).collect(), want, capacity) == len(plain_best_fit([k[3] for k in want.elements()], capacity))
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_packed_ids(spark):
    """Sequences hold the ids of their pieces, back to back."""
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    placed = packing.pack_documents(frame, VOCABULARY, 512, with_ids=True).cache()
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        own = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert own == r.ids and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert sum(map(len, whole.values())) == sum(r.length for r in placed.collect())


def test_words(spark):
    """Ids made word by word are those of whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    rng = random.Random(8)
    texts = ["".join(rng.choice("aB'stredm 1.,\t\n\r\x0b\x0c\x1c\x85\xa0éÉßµªſǅɏΣςİ½²́‍日") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for own in (texts, texts[:1], [""], ["", "a", ""], ["a", "", "b"]):
        coded = [x.encode() for x in own]
        ids, upto = packing.Words(VOCABULARY).ids(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
        assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)] == [e.ids for e in tokenizer.encode_batch(own, add_special_tokens=False)]


def test_manifest_sql(spark):
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    found = base.execute(ORACLE_SQL["op12_merkle_manifest"])
    names = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES["op12_merkle_manifest"](spark, SMALL).select(*names).collect()) == want
