"""The corpus operators against plain versions, on awkward rows and small tables."""

import hashlib
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from docledger.llm import decontam, html, jaccard, langid, lines, mixing, mtree, quality, suffix, warc
from docledger.llm._spark import shared_dir
from docledger.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(rows):
    return [(doc, text, "en", "s", len(text or "")) for doc, text in rows]


def rows_of(spark, name, columns):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    base = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        base.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    found = base.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in frame.select(*columns).collect()) == want


def awkward_texts(seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]), "".join(rng.choice("ab") for _ in range(rng.choice([0, 10, 49, 50, 51, 120, 400])))) for _ in range(150)]
    return rows + [(5, "a" * 3000), (6, "a" * 200), (7, None), (7, None), (8, "é" * 300), (9, "xé" * 200), (9, "xé" * 200), *((40 + i, "ab" * i) for i in range(60))]


def test_suffix_brute(spark):
    rows = rows_of(spark, "documents", ["doc_id", "text"])
    assert sorted(tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, SMALL).collect()) == sorted(plain.repeats(rows))


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_awkward(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "PIECE", 1 << 10)  # texts longer than a piece, and many pieces
    monkeypatch.setattr(suffix, "CHUNK", 1 << 10)
    rows = awkward_texts()
    frame = plain.clashing(spark.createDataFrame(texts(rows), DOCS))
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.remove_repeats(frame).collect()]
    assert sorted(got, key=str) == sorted(plain.repeats(rows), key=str)
    assert suffix.remove_repeats(frame.limit(0)).count() == 0


def test_suffix_whole_characters(spark):
    base = "é" * 60
    frame = spark.createDataFrame([(1, "x" + base), (2, "yé" + base), (3, base[:10])], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffix.remove_repeats(frame, characters=True).collect()}
    assert kept == {1: "x" + base, 2: "yé", 3: base[:10]} or kept == {1: "x" + base, 2: "y", 3: base[:10]}


def test_two_stage():
    import numpy as np

    rng = np.random.default_rng(0)
    for length in (5, 10):
        for _ in range(30):
            sizes = rng.integers(length, 40, rng.integers(1, 6))
            data, ends = rng.integers(0, 3, sizes.sum()).astype(np.uint8), np.cumsum(sizes)
            order = suffix.two_stage(data, ends, sizes - length + 1, length).tolist()
            assert sorted(order) == [int(e - s + i) for e, s in zip(ends, sizes, strict=True) for i in range(s - length + 1)]
            keys = [bytes(data[p : p + length]) for p in order]
            assert keys == sorted(keys)


def awkward_pages():
    big = "é" * 600
    return [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 80), (9, "u", "x" * 300_000), (3, None, big)]


def test_warc(spark):
    where = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = awkward_pages()
    frame = plain.clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.archive_pages(frame, where).collect()
    want = []
    for page, _, page_html in rows:
        payload = (page_html or "").encode()
        same = page_html == rows[0][2]
        revisit = same and page != 3
        want.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    back = warc.read_archives(spark, where, payloads=True).filter("record_type = 'response'").collect()
    assert sorted(bytes(r.payload) for r in back) == sorted((h or "").encode() for p, _, h in rows if h != rows[0][2] or p == 3)
    assert warc.archive_pages(frame.limit(0), f"{where}-none").count() == 0


def test_warc_members():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [block for _, block in warc.parsed(gzip.compress(record) + gzip.compress(record * 2))] == [b"abc"] * 3
    assert [block for _, block in warc.parsed(record)] == [b"abc"]


def test_mtree(spark, monkeypatch):
    for name, value in {"PAGE": 64, "LEAF": 8, "BLOCK": 4, "CELLS": 16, "FANOUT": 4}.items():
        monkeypatch.setattr(mtree, name, value)
    rng = random.Random(3)
    rows = [(i if rng.random() < 0.95 else None, [float(rng.randrange(-2, 3)) for _ in range(rng.choice([3, 3, 3, 5]))]) for i in range(400)]
    rows += [(20, None), (40, [1.0, None, 2.0]), (60, [float("nan"), 1.0, 1.0]), (80, []), (100, [1.0] * 3), (100, [1.0] * 3), (120, [float("inf"), 1.0, 2.0]), *((1000 + i, [2.0] * 3) for i in range(200))]
    frame = plain.clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, mtree.top_products(frame).collect()), key=str) == sorted(plain.top(rows), key=str)
    assert mtree.top_products(frame.limit(0)).count() == 0


def test_lines(spark):
    line = "This line is long enough to count.  "
    rows = [(3, f"{line}\nshort\n{line}"), (1, f"other text here that is long enough\n{line.upper()}"), (2, None), (4, ""), (5, "short"), (None, f"x\n{line}\n"), (6, "y" * 100_000), (7, " \n\n"), (8, "a. " * 50_000)]
    frame = plain.clashing(spark.createDataFrame(texts(rows), DOCS))
    got = {r.doc_id: (r.text, len(r.removed)) for r in lines.remove_repeated_lines(frame).collect()}
    assert {k: (t or "", n) for k, (t, n) in got.items()} == plain.lines(rows) and got[2][0] is None and got[3] == ("short\n", 2)
    repeated = lines.remove_repeated_lines(frame.union(frame)).collect()
    assert len(repeated) == 2 * len(rows) and {r.doc_id: (r.text, len(r.removed)) for r in repeated} == got
    assert lines.remove_repeated_lines(frame.limit(0)).count() == 0
    spans = next(r for r in lines.remove_repeated_lines(frame).collect() if r.doc_id == 3).removed
    assert [rows[0][1][s.start : s.end] for s in spans] == [line + "\n", line]
    every = {r.doc_id: r.text for r in lines.remove_repeated_lines(frame, least=0).collect()}
    assert every == {k: v[0] if k != 2 else None for k, v in plain.lines(rows, 0).items()} and every[5] == "" and every[8] == "a. "


def test_lines_brute(spark):
    """Passages that begin and end inside lines, in scripts with and without spaces."""
    rng = random.Random(9)
    sentences = ["One two three four five six.", "Really? ", "3.14 is not 2.71!", "It was late...", "四季の変化は美しい。", "春が来た！", "No end here", "See www.example.org for more.", "\n", "\n\n", "  "]
    rows = [(n, "".join(rng.choice(sentences) + rng.choice(["", " ", "\n", " \n "]) for _ in range(rng.randrange(12)))) for n in range(300)]
    got = {r.doc_id: (r.text, len(r.removed)) for r in lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.lines(rows)


def test_repeated_lines_go(spark):
    """No line that stood before in the corpus is left, whatever short lines or sentences stand before it."""
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    key = lambda line: " ".join(line.lower().split())
    seen, again = set(), {}
    for doc, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 24:
                if key(line) in seen:
                    again.setdefault(doc, []).append(key(line))
                seen.add(key(line))
    left = {r.doc_id: [key(x) for x in r.text.split("\n")] for r in lines.remove_repeated_lines(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.doc_id in again}
    firsts = {}
    for doc, text in rows:
        for line in text.split("\n"):
            firsts.setdefault(key(line), doc)
    assert sum(map(len, again.values())) > 1000
    assert not [(doc, x) for doc, own in again.items() for x in own if x in left[doc] and firsts[x] != doc]


def test_languages(spark):
    got = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect()
    true = dict(rows_of_large(spark))
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.98 * len(held)


def rows_of_large(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()]


def test_languages_awkward(spark):
    rows = [(i, "the cat and the dog sat " * 3, "en", "s", 1) for i in range(20)] + [(100 + i, "le chat et les chiens sont " * 3, "fr", "s", 1) for i in range(20)]
    rows += [(200, None, "en", "s", 1), (201, "", "en", "s", 1), (202, "12 + 3 = 15!", "en", "s", 1), (None, "the dog sat", None, None, None), (203, "Дом стоит на горе", None, "s", 1), (204, "the " * 400_000, None, "s", 1)]
    frame = plain.clashing(spark.createDataFrame(rows + rows[:1], DOCS))
    got = {r.doc_id: r for r in langid.languages(frame).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[None].lang_pred == "en" and got[204].lang_pred == "en" and got[103].lang_pred == "fr"
    assert got[203].score < 0.1 and all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) for i, r in got.items())
    assert {r.lang_pred for r in langid.languages(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.languages(frame.limit(0)).count() == 0


def test_quality(spark):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op6_site_quality"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 1000
    good = [d for d, x in labels.items() if x == (1, 0)]
    assert sum(got[d].keep for d in good) >= 0.98 * len(good)
    assert sum(not got[d].keep for d in labels if d not in set(good)) >= 0.9 * (len(labels) - len(good))


def test_quality_shrinks(spark):
    """Without evidence from texts a small site is near the global rate; with few labels nothing fails."""
    rng = random.Random(5)
    word = lambda bad: " ".join(rng.choice(["###", "$$$"] if bad else ["house", "garden", "tree"]) for _ in range(30))
    rows = [(i, word(i % 10 < (8 if i < 500 else 2)), "en", "bad" if i < 500 else "good", 1) for i in range(1000)] + [(2000, "", "en", "bad", 1), (2001, None, "en", "good", 1), (2002, "", "en", "new", 1), (None, "house tree", None, None, 1)]
    docs = plain.clashing(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(i, int(i % 10 >= (8 if i < 500 else 2)), 0) for i in range(0, 1000, 7)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.posteriors(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert got[2000].posterior < 0.4 < got[2002].posterior < 0.6 < got[2001].posterior
    assert sum(got[i].keep == (i % 10 >= (8 if i < 500 else 2)) for i in range(1000)) > 980 and len(got) == 1004
    for some in (labels.limit(0), labels.filter("quality = 1")):
        assert quality.posteriors(docs, some, F.col("source"), F.col("lang")).count() == 1004
    assert quality.posteriors(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def near_rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 40, 80]))]
        for _ in range(rng.choice([1, 2, 8, 20])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice([*words, "X", "Y"])
            rows.append((rng.choice([None, *range(500)]), rng.choice([" ", "\n", "  "]) + " ".join(own)))
    return rows + [(1, None), (2, ""), (3, "  \n"), (3, "  \n"), (4, "a b"), (5, "a b"), (6, "A B"), (7, "a  b c"), (8, "x" * 1_500_000)]


def test_jaccard(spark):
    rows = rows_of(spark, "documents", ["doc_id", "text"])
    assert sorted(tuple(r) for r in QUERIES["op7_jaccard_join"](spark, SMALL).collect()) == sorted(plain.components(rows))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_awkward(spark, k, num):
    rows = near_rows()
    frame = plain.clashing(spark.createDataFrame(texts(rows), DOCS))
    want = plain.components(rows, k, num)
    assert sorted(map(tuple, jaccard.similar(frame, k, num).collect()), key=str) == sorted(want, key=str)
    kept = jaccard.distinct(frame, k, num).collect()
    no_words = sum(1 for _, n, _ in want if not n)
    groups = plain.components([(i, t) for i, (_, t) in enumerate(rows)], k, num)
    assert len(kept) == len({c for _, n, c in groups if n}) + no_words
    assert jaccard.similar(frame.limit(0), k, num).count() == 0


def test_jaccard_hub(spark):
    """Copies that only link through their original are one component, without all pairs."""
    rng = random.Random(4)
    base = [f"word{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        own = list(base)
        for at in rng.sample(range(200), 3):
            own[at] = f"odd{i}-{at}"
        rows.append((i, " ".join(own)))
    got = {tuple(r) for r in jaccard.similar(spark.createDataFrame(texts(rows), DOCS)).collect()}
    assert got == set(plain.components(rows)) and len({c for *_, c in got}) == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><div class="ad">Buy now</div>
<article class="post"><h1>Title &amp; more</h1><p><b>First</b> para&shy;graph<br>goes   on.<p>Second &lt;one&gt; caf&eacute;.<div class="ad-slot">Ad inside</div><p>Third.</p>
<form><input name=q><button>Go</button></form></article><aside>Side</aside><section id="comments"><p>Nice post! I liked it very much indeed, thanks to the author for it.</p></section><footer>&copy; me</footer></body>"""


def test_html():
    assert html.extract(PAGE) == "Title & more\n\nFirst para­graph goes on.\n\nSecond <one> café.\n\nThird."
    assert html.extract(None) == html.extract("") == html.extract("<script>x") == html.extract("<div") == ""
    assert html.extract("just text, with no markup at all") == "just text, with no markup at all"


def test_html_without_article():
    menu = "".join(f'<li><a href="/{i}">Menu item {i}</a></li>' for i in range(8))
    body = "".join(f"<p>Paragraph {i} of the story goes on for quite a while, as stories do when they are told.</p>" for i in range(6))
    text = html.extract(f"<body><ul>{menu}</ul><div>{body}<p>Short.</p>{body}</div><div><a href='x'>Imprint</a> | <a href='y'>Terms</a></div></body>")
    assert text.count("\n\n") == 12 and "Short." in text and "Menu" not in text and "Imprint" not in text


def test_html_articles_elsewhere():
    story = "".join(f"<p>Paragraph {i} of the story goes on for quite a while, as stories do when they are told.</p>" for i in range(6))
    teaser = "<article><h3>More</h3><p>Another story that you may want to read next.</p></article>"
    comment = "<article class=comment><p>I have read this and must say that it is not at all what I had thought of.</p></article>"
    want = "\n\n".join(f"Paragraph {i} of the story goes on for quite a while, as stories do when they are told." for i in range(6))
    for main in (f"<div>{story}</div>", f"<article>{story}</article>", f"<article class='post has-sidebar'>{story}</article>", f"<div class=has-sidebar><article>{story}</article></div>"):
        for more in ("", f"<div class=related>{teaser}</div>", f"<section id=comments>{comment * 3}</section>", f"<section id=comments>{comment * 12}</section>", comment):
            assert html.extract(f"<body>{main}{more}</body>") == want, (main, more)
    assert html.extract(f"<body><div>{story}</div>{teaser}</body>").startswith(want)  # nothing marks the teaser
    assert html.extract(f"<div class=modal><article>{story}</article></div>") == want
    assert html.extract(f"<article><p>Short.</p></article><div><a href=x>{'Menu ' * 40}</a></div><p>Imprint</p>") == "Short."


def test_html_brute():
    """Pages give what the standard parser finds in their article; without the article's tags, all but short blocks before the surge."""
    import re

    import pyarrow.parquet as pq

    pages = [x["html"] for x in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    assert all(html.extract(page) == plain.article(page) for page in pages)
    bare = [re.sub("</?article>", "", page or "") for page in pages]
    pairs = [(html.extract(page), plain.article(whole)) for page, whole in zip(bare, pages, strict=True)]
    assert sum(got == want for got, want in pairs) >= 0.95 * len(pairs)
    assert all(want.endswith(got) and len(want) - len(got) < html.SURGE for got, want in pairs)


@pytest.mark.parametrize("mark", ["share-price", "social-science", "search-results", "ad-hoc", "notice", "comment", "sponsored"])
def test_html_marked_article(mark):
    """A mark around most of a page's text does not make it go."""
    story = "".join(f"<p>Paragraph {i} of the story goes on for quite a while, as stories do when they are told.</p>" for i in range(6))
    want = "\n\n".join(f"Paragraph {i} of the story goes on for quite a while, as stories do when they are told." for i in range(6))
    for name in ("div", "section", "article", "form"):
        for more in ("", "<p>Imprint</p>", "<div class=ad>Buy now</div>"):
            assert want in html.extract(f"<body><nav><a href=x>Menu</a></nav><{name} class='{mark}'>{story}</{name}>{more}</body>"), (name, more)
    assert html.extract(f"<body><div>{story}</div><div class='{mark}'><p>Something else of some length that one may read.</p></div></body>") == want


def test_html_around_the_article():
    story = "".join(f"<p>Paragraph {i} of the story goes on for quite a while, as stories do when they are told.</p>" for i in range(6))
    want = "\n\n".join(f"Paragraph {i} of the story goes on for quite a while, as stories do when they are told." for i in range(6))
    assert html.extract(f"<header>Site</header><h1>Title</h1><article>{story}</article>") == f"Title\n\n{want}"
    assert html.extract(f"<main><p>Short.</p></main><div>{story}</div>").endswith(want)
    assert html.extract(f"<div>{story}<p>See <a href=x>this longer story about it</a></p>{story}</div>").count("\n\n") == 12
    assert html.extract(f"<form action=y id=page><div>{story}</div><input name=q></form>") == want


def test_html_rows(spark):
    frame = plain.clashing(spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "x " * 200_000)], "page_id long, url string, html string"))
    got = html.main_text(frame).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.n_chars for r in got}[3] == 399_999
    assert html.main_text(frame.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(300)]), " ".join(["w"] * rng.choice([0, 1, 3, 40, 400])), "en", rng.choice(["a", "b", "c", "d", None]), 1) for _ in range(400)] + [(1, None, "en", "a", 1), (2, "x " * 9, "en", "empty", 1), (3, "", "en", "zero", 1)]
    rows += rows[:20]
    frame = plain.clashing(spark.createDataFrame(rows, DOCS))
    got = mixing.mix_sources(frame).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        own = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        own[0] += r.size
        own[1] += r.taken
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
    assert all(size == own and taken <= 2 * size and abs(taken - target) <= 40 for size, taken, target, own in by.values())
    assert abs(sum(t for _, _, t, _ in by.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(str, mixing.mix_sources(frame.repartition(7)).select("doc_id", "source", "size", "taken").collect())) == sorted(map(str, mixing.mix_sources(frame).select("doc_id", "source", "size", "taken").collect()))
    assert mixing.mix_sources(frame.limit(0)).count() == 0


def rates(frame, **options):
    """(asked, measured) share of the words that documents are sampled with, by chance in tenths, over several seeds."""
    found = {}
    for seed in "ab":
        for r in mixing.mix_sources(frame, budget=0.4, weights=(1,), seed=seed, **options).filter("chance is not null").collect():
            own = found.setdefault(int(r.chance * 10), [0, 0.0, 0])
            own[0] += 1
            own[1] += r.chance
            own[2] += r.sampled
    return {k: (asked / n, got / n) for k, (n, asked, got) in found.items() if n >= 400}


def test_mixing_inclusion(spark):
    """Inclusion rates are those asked for: by size, up to certain documents, and by a column of weights."""
    frame = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 + case when id % 200 = 0 then 3000 else 0 end as int)) as text", "'s' || id % 2 as source", "id % 4 as wish", "'x' as chance")
    by_size, by_wish = rates(frame), rates(frame, weight_col="wish")
    for found in (by_size, by_wish):
        assert len(found) >= 2 and all(got == pytest.approx(asked, abs=0.04) for asked, got in found.values()), found
    largest = mixing.mix_sources(frame, budget=0.9, weights=(1,)).filter("size > 3000").collect()
    assert all(r.chance > 0.999 and r.sampled for r in largest)


def test_mixing_one_large_document(spark):
    """A document with a third of its source is taken or passed over; either way the source comes near its target."""
    rows = [(i, "w " * 100, "a") for i in range(600)] + [(1000, "w " * 30_000, "a"), (1001, "w " * 60_000, "b"), *((2000 + i, "w " * 50, "b") for i in range(40))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in "ab":
        for budget in (0.3, 0.7):
            got = mixing.mix_sources(frame, budget=budget, weights=(1,), seed=seed)
            by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
            for r in by:
                least = 0 if r.source == "a" else 60_000 - 2 * 2000  # nothing in b but one document that large
                assert abs(r.taken - r.target) <= max(100, least if r.target % 62_000 > 2000 else 0), (seed, budget, r)


def test_edits():
    rng = random.Random(1)

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    for _ in range(150):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(12))]
        assert decontam.edits(a, b) == [min(distance(a, b[i:j]) for i in range(j + 1)) for j in range(1, len(b) + 1)]


def edited(rng, text, changes):
    """A text with so many characters replaced, left out or put in."""
    own = list(text)
    for _ in range(changes):
        at = rng.randrange(len(own))
        own[at : at + 1] = rng.choice([["q"], [], [own[at], "q"], [" "]])
    return "".join(own)


def test_leaks(spark):
    items = rows_of(spark, "benchmark", ["item_id", "text"])
    rows = rows_of(spark, "documents", ["doc_id", "text"])
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_benchmark_leaks"](spark, SMALL).collect()}
    assert {(d, i) for d, t in rows for i, item in items if item in t} <= got
    short = [(d, t) for d, t in rows if len(t) <= 800]
    assert {(d, i) for d, i in got if d in dict(short)} == plain.leaks(items, short)
    rng = random.Random(3)
    cut = [(n, f"{t} " + edited(rng, items[n % len(items)][1], rng.randrange(len(items[n % len(items)][1]) // 3))) for n, (_, t) in enumerate(short[:40])]
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(cut, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain.leaks(items, cut)
    assert found <= want and len(found) >= 0.9 * len(want)


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.2])
def test_leaks_by_characters(spark, rate):
    """Of items with as many characters edited as allowed, 0.9 and more are found."""
    rng = random.Random(rate)
    items, texts_ = rows_of(spark, "benchmark", ["item_id", "text"]), [t for _, t in rows_of(spark, "documents", ["doc_id", "text"])]
    rows = [(n, f"{rng.choice(texts_)[:300]} {edited(rng, items[n % len(items)][1], int(rate * len(items[n % len(items)][1])))} {rng.choice(texts_)[:300]}") for n in range(200)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((n, items[n % len(items)][0]) in got for n, _ in rows) >= 0.9 * len(rows)


def test_leaks_edited(spark):
    rng = random.Random(8)
    items = rows_of(spark, "benchmark", ["item_id", "text"])
    filler = [w for _, t in rows_of(spark, "documents", ["doc_id", "text"])[:20] for w in t.split()]
    rows, edited = [], {}
    for n in range(400):
        item, text = rng.choice(items)
        own = text.split()
        changes = int(rng.choice([0, 0.1, 0.2]) * len(own))
        for _ in range(changes):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([["zz"], [], [own[at], "yy"]])
        at = rng.randrange(len(filler) - 200)
        rows.append((n, " ".join(filler[at : at + 100] + own + filler[at + 100 : at + 200])))
        edited[n] = item
    rows += [(900, None), (901, ""), (902, "x" * 2_000_000), (None, items[0][1]), (903, items[0][1].upper() + " " + items[0][1])]
    docs = plain.clashing(spark.createDataFrame(texts(rows), DOCS))
    bench = spark.createDataFrame([*items, (1000, None), (1001, ""), (1002, "two words")], "item_id long, text string")
    found = decontam.leaks(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert sum((n, i) in got for n, i in edited.items()) >= 0.95 * len(edited)
    assert (None, items[0][0]) in got and sum(r.doc_id == 903 and r.item_id == items[0][0] for r in found) == 2
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [5, 6, 9, 10, 12, 15, 20, 40])
def test_leaks_by_size(size):
    """Items of each length with as many words edited as allowed are all found, at the begin of a text, too."""
    import numpy as np

    rng = random.Random(size)
    items = [(n, f"item {n}", np.array([rng.randrange(1 << 62) for _ in range(size)], np.uint64)) for n in range(200)]
    sketch = decontam.Seeds([(n, own, b"") for n, _, own in items], decontam.RATE)
    found = 0
    for n, _, own in items:
        words = own.tolist()
        for at in rng.sample(range(size), int(decontam.RATE * size)) if n % 2 else range(int(decontam.RATE * size)):
            words[at : at + 1] = rng.choice([[rng.randrange(1 << 62)], [], [words[at], rng.randrange(1 << 62)]]) if at < len(words) else []
        got = sketch.candidates(np.array(words + [rng.randrange(1 << 62) for _ in range(30)], np.uint64))
        found += any(item == n and abs(start) <= size // 5 + 1 for start, item in got)
    assert found == len(items)


def test_leaks_short(spark):
    """Items of a few words, and in scripts without spaces, are found wherever they stand."""
    items = [(1, "blue"), (2, "two small words"), (3, "四季の変化は美しい"), (4, "猫"), (5, "ภาษาไทย"), (6, "été"), (7, "𠀀𠀁"), (8, "?!")]
    rows = [(10, "The BLUE sky, and two  small words."), (11, "日本の四季の変化は美しいと思う猫です"), (12, "เรียนภาษาไทยวันนี้ l'été?!"), (13, "bluer two words small"), (14, "x𠀀𠀁y"), (15, "四季の変化も美しい")]
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(10, 1), (10, 2), (11, 3), (11, 4), (12, 5), (12, 6), (14, 7), (15, 3)}
    text = dict(rows)
    assert {text[r.doc_id][r.start : r.end].lower() for r in found if r.edits == 0} == {"blue", "two  small words", "四季の変化は美しい", "猫", "ภาษาไทย", "été", "𠀀𠀁"}


def test_only_empty_texts(spark):
    frame = spark.createDataFrame([(1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, "", None, None, None)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some words that make an item")], "item_id long, text string")
    assert {(r.n_shingles, r.component_id) for r in jaccard.similar(frame).collect()} == {(0, 1), (0, 2), (0, 3)}
    assert jaccard.distinct(frame).count() == 3 and decontam.leaks(frame, bench).count() == 0
    assert {r.n_removed for r in suffix.remove_repeats(frame).collect()} == {0}
    assert quality.posteriors(frame, labels, F.col("source"), F.col("lang")).count() == 3
    assert {r.lang_pred for r in langid.languages(frame).collect()} == {"und"}
    assert {r.taken for r in mixing.mix_sources(frame).collect()} == {0}
    assert lines.remove_repeated_lines(frame).count() == 3
