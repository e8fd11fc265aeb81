"""Substring deduplication by hashing normalised lines, and the sentences in them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm._spark import Tables

BLANK = " \t\n\v\f\r"
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
#: A sentence: up to its line's end, or to marks that white space follows (in Chinese and Japanese, anything), with the white space behind it.
SENTENCE = re.compile(r"(?:[^\n.!?。！？]+|[.!?]+[^\x20\x09-\x0D.!?。！？])*+[.!?。！？]*+[\x20\x09-\x0D]*+")
FEEDS = re.compile(r"\n[\x20\x09-\x0D]*\Z")
LEAST_CHARS = 24
FLUSH = 100_000
SPAN = "array<struct<start:long,end:long>>"


def normalise(unit: str) -> bytes:
    """In lower case and with single spaces; bytes are split at ASCII white space only."""
    return b" ".join(unit.lower().encode().split())


def units(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normal form) of a text's lines and sentences that are not blank, each line before its sentences.

    A line of one sentence is that sentence. A sentence takes the white space behind it, the line feeds at its line's end included.
    """
    line: list[tuple[int, int, bytes]] = []

    def done() -> Iterator[tuple[int, int, bytes]]:
        if len(line) > 1:
            parts = [key + (b" " if text[end - 1] in BLANK else b"") for _, end, key in line]
            yield line[0][0], line[-1][1], b"".join(parts).rstrip()
        yield from line

    for m in SENTENCE.finditer(text):
        start, end = m.span()
        if end > start:
            unit = m.group()
            if key := normalise(unit):
                line.append((start, end, key))
            if "\n" in unit:
                yield from done()
                line.clear()
    yield from done()


def outermost(cuts: list[dict]) -> list[dict]:
    """Spans without those inside others."""
    out: list[dict] = []
    for cut in sorted(cuts, key=lambda c: (c["start"], -c["end"])):
        if not out or cut["start"] >= out[-1]["end"]:
            out.append(cut)
    return out


def spans(docs: DataFrame, least: int) -> DataFrame:
    """(id, version, unit, digest, start, stop) of all units that are not blank."""
    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("version long, unit long, digest binary, start long, stop long").fields])

    def batch_of(ids: pa.Array, versions: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        row, unit, digest, start, stop = zip(*rows, strict=True)
        at = pa.array(row, pa.int32())
        return pa.RecordBatch.from_arrays([ids.take(at), versions.take(at), pa.array(unit, pa.int64()), pa.array(digest, pa.binary()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, texts = batch.columns
            rows: list[tuple] = []
            for i, text in enumerate(texts.to_pylist()):
                for n, (a, b, key) in enumerate(units(text or "")):
                    if len(key) >= least:
                        b = a + len(FEEDS.sub("", text[a:b])) if a and text[a - 1] != "\n" else b  # the line before ends here
                        rows.append((i, n, hashlib.blake2b(key, digest_size=16).digest(), a, b))
                        if len(rows) >= FLUSH:
                            yield batch_of(ids, versions, rows)
                            rows = []
            if rows:
                yield batch_of(ids, versions, rows)

    return docs.mapInArrow(cut, schema)


def without(text: str, cuts: list[dict]) -> str:
    parts, at = [], 0
    for cut in cuts:
        parts.append(text[at : cut["start"]])
        at = cut["end"]
    return "".join([*parts, text[at:]])


def remove_repeated_lines(docs: DataFrame, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Removes every line, and every sentence within a line, that has occurred before in the corpus.

    Lines and sentences are units of their own, whatever stands beside them: a line that occurred before goes whole, one that did
    not loses the sentences that occurred before, as lines or as sentences. So a passage that begins or ends inside lines is
    found but for the parts of sentences at its ends. Units whose normal form has under `least` bytes stay (a lone word is no
    repeat), but go with their line. Units are compared by a 128-bit digest after white space is made uniform
    and case is folded; of equal units the one of the smallest id, then the first within its document, stays. Returns id, text (what
    is left), n_units (sentences that are not blank), removed (the spans taken out, in characters of the original text; of a
    unit that does not begin its line the line feeds behind it stay).

    A null text has no units and stays null; an empty one stays empty. Null ids rank last. Rows with the same id and
    text are one document and get the same result; equal ids with different texts rank by a hash of the text. Extra
    columns are not read. First occurrences are found by an aggregate that combines before the shuffle; occurrences are
    then joined to the repeated digests, a join whose hot keys adaptive execution can split.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    found = spans(docs, least)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "version", "unit")
    tables = Tables(spark, "lines")
    firsts = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    repeated = tables.write(firsts.filter("n > 1").select("digest", "first"), "repeated")
    removed = F.array_sort(F.collect_set(F.struct("start", F.col("stop").alias("end"))))
    dropped = found.join(repeated, "digest").filter(place != F.col("first")).groupBy("id", "version").agg(removed.alias("removed"))
    dropped = tables.write(dropped.withColumnsRenamed({"id": "i", "version": "v"}), "dropped")
    tables.drop("repeated")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, cuts = batch.columns
            left, counts, spans_ = [], [], []
            for text, own in zip(texts.to_pylist(), cuts.to_pylist(), strict=True):
                counts.append(sum(1 for m in SENTENCE.finditer(text or "") if m.end() > m.start() and (text[m.start()] not in BLANK or not BLANKS.fullmatch(text, *m.span()))))
                spans_.append(outermost(own))
                left.append(without(text, spans_[-1]) if own else text)
            yield pa.RecordBatch.from_arrays([ids, pa.array(left, pa.string()), pa.array(counts, pa.int64()), pa.array(spans_, cuts.type)], names=schema.names)

    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v"))
    joined = docs.join(dropped, same, "left").select("id", "text", F.coalesce("removed", F.from_json(F.lit("[]"), SPAN)).alias("removed"))
    schema = T.StructType([docs.schema["id"], T.StructField("text", T.StringType()), T.StructField("n_units", T.LongType()), T.StructField("removed", joined.schema["removed"].dataType)])
    return joined.mapInArrow(kept, schema).withColumnRenamed("id", id_col)


SQL = r"""
with cut as (select doc_id, coalesce(text, '') as text,
    list_filter(regexp_extract_all(coalesce(text, ''), '(?:[^\n.!?。！？]+|[.!?]+[^\x20\x09-\x0D.!?。！？])*[.!?。！？]*[\x20\x09-\x0D]*'), lambda x: x <> '') as us from documents),
each as (select doc_id, unnest(us) as u, generate_subscripts(us, 1) as k from cut),
placed as (select *, sum(length(u)) over (partition by doc_id order by k) - length(u) as a, coalesce(sum(contains(u, chr(10))::integer) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as ln,
    lower(trim(regexp_replace(u, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as key from each),
sentences as (select doc_id, ln, 1 as level, a, u, key from placed where key <> ''),
whole as (select doc_id, ln, 0 as level, min(a) as a, string_agg(u, '' order by a) as u from sentences group by doc_id, ln having count(*) > 1),
units as (select * from sentences union all select *, lower(trim(regexp_replace(u, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) from whole),
ranked as (select *, row_number() over (partition by key order by doc_id nulls last, a, level) > 1 as again from units where strlen(key) >= 24),
gone as (select r.doc_id, ln, level, cast(r.a as bigint) as a, cast(r.a + length(case when r.a > 0 and c.text[r.a::bigint] <> chr(10) then regexp_replace(u, '\n[\x20\x09-\x0D]*$', '') else u end) as bigint) as e
    from ranked r join cut c on r.doc_id is not distinct from c.doc_id where again),
outer_ as (select g.*, lag(e, 1, 0) over (partition by doc_id order by a) as before from gone g where level = 0 or not exists (select 1 from gone h where h.level = 0 and h.doc_id is not distinct from g.doc_id and h.ln = g.ln)),
done as (select o.doc_id, count(*) as n_removed, string_agg(a || '-' || e, ';' order by a) as removed, string_agg(substr(c.text, before + 1, a - before), '' order by a) || substr(any_value(c.text), max(e) + 1) as kept from outer_ o join cut c on o.doc_id is not distinct from c.doc_id group by o.doc_id)
select c.doc_id, (select count(*) from sentences s where s.doc_id is not distinct from c.doc_id) as n_units, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed, cast(length(coalesce(kept, c.text)) as bigint) as n_chars, md5(coalesce(kept, c.text)) as kept_md5
from cut c left join done d on c.doc_id is not distinct from d.doc_id
"""
