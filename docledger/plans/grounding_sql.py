"""The SQL of the grounding queries: every admitted window of every printed invoice, scored, and claimed row by row."""

from docledger.functions.text import CODES, MARKS
from docledger.operators.grounding import LABELS, MONEY_TOKEN
from docledger.plans.derived import CTES
from docledger.plans.rule_queries import amount

STYLED = """styled as (select *, (document_id + idx) % 7 as st, format('{:,}', cents // 100) as g, lpad(cast(cents % 100 as varchar), 2, '0') as c from lines),
shown as (select *, case st when 0 then g || '.' || c when 1 then replace(g, ',', '.') || ',' || c when 2 then replace(g, ',', ' ') || ',' || c when 3 then '$' || g || '.' || c when 4 then replace(g, ',', '.') || ',' || c || ' €' when 5 then '(' || g || '.' || c || ')' else 'USD ' || g || '.' || c || '-' end as shown from styled)"""
CODE = rf"\b(?:{'|'.join(CODES)})\b"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def read(source: str) -> str:
    """Columns shaped, cents, of strings s: whether they read as amounts, and which."""
    return f"""(select s, shaped, case when shaped and digits <> '' then try_cast(round(try_cast('0' || digits as decimal(28,6)), 2) * 100 as bigint) * case when negative then -1 else 1 end end as cents from (
  select *, case when regexp_matches(plain, '^[1-9][\\d,]*,\\d{{3}}$|^[1-9][\\d.]*\\.\\d{{3}}$') then regexp_replace(plain, '[.,]', '', 'g')
    when regexp_matches(plain, '[.,]') then regexp_replace(regexp_extract(plain, '^(.*)[.,]([^.,]*)$', 1), '[.,]', '', 'g') || '.' || regexp_extract(plain, '^(.*)[.,]([^.,]*)$', 2) else plain end as digits
  from (select *, regexp_replace(bare, '[^\\d.,]', '', 'g') as plain, regexp_matches(bare, '(?i)^\\(.*\\)$|^-|-$|cr$') as negative from (
    select s, regexp_replace(regexp_replace(s, {quoted(f'(?i)[{MARKS}]|{CODE}')}, '', 'g'), '[\\s'']+', '', 'g') as bare,
      regexp_matches(s, '\\d') and not contains(s, '%') and (regexp_matches(s, '[{MARKS}]') or regexp_matches(s, '\\d[.,'']\\d') or regexp_matches(s, '[.,]\\d{{2}}\\D*$')) as shaped from ({source})))))"""


NORM = f"coalesce({amount('cents')}, trim(regexp_replace(regexp_replace(lower(s), '[{MARKS}]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"
KEY = f"regexp_replace(regexp_replace(lower(s), {quoted(CODE)}, '', 'g'), '[\\s{MARKS}]', '', 'g')"

#: Tokens of the printed pages, with the next three; candidates; where they may start; and windows, read.
PAGES = f"""{CTES}, {STYLED},
ends as (select document_id, count(*) as n, sum(cents) as s from lines group by 1),
printed as (select document_id, idx as line, description || ' ' || qty || ' ' || shown as txt from shown
  union all select document_id, n, 'Subtotal ' || format('{{:,}}', cast(s as bigint) // 100) || '.' || lpad(cast(s % 100 as varchar), 2, '0') from ends
  union all select document_id, n + 1, 'Total ' || format('{{:,}}', cast(s as bigint) // 100) || '.' || lpad(cast(s % 100 as varchar), 2, '0') from ends),
words as (select document_id, line, unnest(string_split(txt, ' ')) as s, generate_subscripts(string_split(txt, ' '), 1) - 1 as col from printed),
known as (select s, {NORM} as norm, {KEY} as key, regexp_matches(s, {quoted(MONEY_TOKEN)}) as money, regexp_matches(s, '\\d') as digit from {read('select distinct s from words')}),
tok as materialized (select document_id, cast(line as integer) as line, col, s as t, norm, key, money, digit, cast(row_number() over (partition by document_id order by line, col) - 1 as integer) as n from words join known using (s)),
cand as materialized (
  select *, cast(1 as integer) as words from (
    select document_id, f as field, cast(null as integer) as idx, {amount('s')} as raw, cast(s as bigint) as cents from ends, (select unnest(['total', 'subtotal']) as f)
    union all select document_id, 'lineItems.' || idx || '.amount', idx, {amount('cents')}, cents from lines)
  union all select document_id, 'lineItems.' || idx || '.description', idx, description, null, 2 from lines),
adm as materialized (
  select c.*, lower(c.raw) as cnorm, replace(lower(c.raw), ' ', '') as ckey, t.n from cand c join tok t on t.document_id = c.document_id
    and (t.t = split_part(c.raw, ' ', 1) or (t.norm <> '' and split_part(t.norm, ' ', 1) = split_part(lower(c.raw), ' ', 1)) or (t.digit and c.cents is not null) or (t.key <> '' and t.key[1] = lower(c.raw)[1]))),
wide as (select *, {', '.join(f"lead({c}, {i}) over w as {c}{i}" for c in ('t', 'norm', 'key', 'money') for i in (1, 2, 3))} from tok window w as (partition by document_id order by n)),
sized as (select document_id, n, line, col, unnest([1, 2, 3, 4]) as size, unnest([t, t || ' ' || t1, t || ' ' || t1 || ' ' || t2, t || ' ' || t1 || ' ' || t2 || ' ' || t3]) as s,
  unnest([norm, norm || ' ' || norm1, norm || ' ' || norm1 || ' ' || norm2, norm || ' ' || norm1 || ' ' || norm2 || ' ' || norm3]) as norms,
  unnest([key, key || key1, key || key1 || key2, key || key1 || key2 || key3]) as key, unnest([money, money and money1, money and money1 and money2, false]) as money from wide),
win as materialized (select document_id, n, line, col, cast(size as integer) as size, z.s, trim(regexp_replace(norms, ' +', ' ', 'g')) as norm, key, case when money then cents end as cents
  from sized z left join {read('select distinct s from sized where money')} r on z.money and r.s = z.s where z.s is not null)"""

#: All hits of all candidates, with the distance to the field's label.
HITS = f"""{PAGES},
scored as (select a.document_id, a.field, a.idx, a.n, w.line, w.col, w.size, case when w.s = a.raw then 1.0 when w.norm = a.cnorm then 0.9 when w.cents = a.cents then 0.9
    when length(a.ckey) >= 3 and abs(length(w.key) - length(a.ckey)) <= greatest(2, length(a.ckey) // 4) and length(w.key) > 0 then (select case when sim >= 0.85 then sim * 0.8 end from (select 1 - damerau_levenshtein(w.key, a.ckey) / greatest(length(w.key), length(a.ckey)) as sim)) end::double as score,
    w.s = a.raw as exact, coalesce(w.norm = a.cnorm or w.cents = a.cents, false) as normal
  from adm a join win w on w.document_id = a.document_id and w.n = a.n and w.size <= a.words + 2),
labelled as (select t.document_id, l.field, 0.04 as cx, round(t.line * 0.05, 4) + 0.01 as cy from tok t join (values ('total', 'total'), ('subtotal', 'subtotal')) l(field, norm) on t.norm = l.norm),
hits as materialized (select h.*, cast(h.n as integer) as s, cast(h.n + h.size as integer) as e, abs(l.cy - (round(h.line * 0.05, 4) + 0.01)) * 3 + abs(l.cx - (round(h.col * 0.1, 4) + round(round(h.col * 0.1 + (h.size - 1) * 0.1 + 0.08, 4) - round(h.col * 0.1, 4), 4) / 2)) as far
  from scored h left join labelled l on l.document_id = h.document_id and l.field = h.field where score is not null)"""

PICK = "first({'s': h.s, 'e': h.e, 'line': h.line, 'score': h.score, 'method': case when h.exact then 'exact' when h.normal then 'normalized' else 'fuzzy' end} order by h.score desc, h.size, %s)"
GROUND = f"""{HITS.replace('with raw_lines', 'with recursive raw_lines', 1)},
total as (select document_id, {PICK % 'h.far nulls last, h.s'} as p from hits h where field = 'total' group by 1),
subtotal as (select h.document_id, {PICK % 'h.far nulls last, h.s'} as p from hits h left join total t on t.document_id = h.document_id where field = 'subtotal' and not coalesce(h.s < t.p.e and h.e > t.p.s, false) group by 1),
texts as materialized (select * from hits where field like '%description'),
named as (
  select document_id, 0 as i, n, [{{'s': -1, 'e': -1}}] as taken, null::struct(s integer, e integer, line integer, score double, method varchar) as p from ends
  union all
  select r.document_id, r.i + 1, any_value(r.n), case when count(h.s) > 0 then list_append(any_value(r.taken), first({{'s': h.s, 'e': h.e}} order by h.score desc, h.size, h.s)) else any_value(r.taken) end,
    case when count(h.s) > 0 then {PICK % 'h.s'} end
  from named r left join texts h on h.document_id = r.document_id and h.idx = r.i and len(list_filter(r.taken, lambda x: h.s < x.e and h.e > x.s)) = 0 where r.i < r.n group by r.document_id, r.i),
described as (select document_id, i - 1 as idx, p from named where i > 0 and p is not null),
cells as (select h.document_id, h.idx, {PICK % 'case when d.p is null then 0 else abs(h.line - d.p.line) end, case when d.p is null then 0 when h.s >= d.p.e then 0 else 1 end, h.col desc, h.s'} as p
  from hits h left join described d on d.document_id = h.document_id and d.idx = h.idx where h.field like '%amount' and not coalesce(h.s < d.p.e and h.e > d.p.s, false) group by 1, 2),
places as (select document_id, 'total' as field_path, p from total union all select document_id, 'subtotal', p from subtotal
  union all select document_id, 'lineItems.' || idx || '.description', p from described union all select document_id, 'lineItems.' || idx || '.amount', p from cells)
select document_id, field_path, p.s as start, p.e as end, p.method as method, floor(p.score * 1000 + 0.5) / 1000 as score from places"""

WINDOWS = f"""{PAGES},
begun as (select document_id, n, max(words) + 2 as most, bool_or(cents is not null) as amounts from adm group by 1, 2)
select document_id, count(*) as n, max(size) as longest, count(*) filter (where amounts and cents is not null) as amounts from begun join win using (document_id, n) where size <= most group by 1"""

LABEL_ROWS = ", ".join(f"({quoted(field)}, {quoted(label)})" for field, names in LABELS.items() for label in names)
PRINTED_LABELS = f"""{PAGES},
phrases as (select field, trim(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as phrase from (values {LABEL_ROWS}) v(field, label)),
many as (select document_id, line, norm as one, norm || ' ' || lead(norm) over w as two from tok window w as (partition by document_id order by n)),
met as (select document_id, line, field from many join phrases on phrase = one or phrase = two)
select document_id, field, count(*) as n, round((min(round(line * 0.05, 4)) + 0.01)::double, 6) as cy from met group by 1, 2"""

ORACLE_SQL = {"g05_windows": WINDOWS, "g09_labels": PRINTED_LABELS, "g11_ground_document": GROUND}
