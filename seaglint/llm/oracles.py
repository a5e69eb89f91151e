"""SQL twins of the text queries that SQL can express, for DuckDB."""

from __future__ import annotations

import string
from math import ceil

from seaglint.llm import license_scan as licenses
from seaglint.llm import mixing, phrase_dedup

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def license_sql() -> str:
    phrases = ", ".join(f"({texts(p.split())}, {text(label)})" for p, label in licenses.PHRASES)
    templates = []
    for t, label in licenses.TEMPLATES:
        tokens = sorted(set(t.split()))
        templates.append(f"({texts(tokens)}, {len(tokens)}, {max(1, ceil(round(licenses.CONTAINMENT * len(tokens), 9)))}, {text(label)})")
    size, step = licenses.BLOCK_WORDS, licenses.BLOCK_WORDS // 2
    joined = "array_to_string(list_sort(list_distinct({})), ',')"
    return f"""
with d as (
 select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
p(words, label) as (values {phrases}),
t(tokens, n, need, label) as (values {", ".join(templates)}),
s as (select doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(words) - 1] = words)) - 1 as place from d, p),
base as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as labels from s group by 1),
b as (select doc_id, w, unnest(range(0, greatest(0, len(w) - 1 - {step}) + 1, {step})) as place from d),
f as (select doc_id, label, len(list_intersect(list_distinct(w[place + 1:place + {size}]), tokens)) as k, n, need from b, t),
more as (select doc_id, max(k / n) as part, list(distinct label) as labels from f where k >= need group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
 {joined.format("coalesce(base.labels, [])")} as base_labels,
 {joined.format("list_concat(coalesce(base.labels, []), coalesce(more.labels, []))")} as labels,
 case when n_base > 0 then 1e0 else coalesce(part, 0e0) end as score
from d left join base using (doc_id) left join more using (doc_id)"""


def mixing_sql() -> str:
    k, weights, copies = len(mixing.WEIGHTS), list(mixing.WEIGHTS), mixing.MAX_COPIES
    taken = " + ".join(f"case when (size > 0) and ((sent + {c} * source_size) / target, number) <= (finish, last_number) then 1 else 0 end" for c in range(copies))
    return f"""
with d as (
 select doc_id, source, cast(len({WORDS}) as bigint) as size,
  md5(concat('{mixing.SEED}', ':', coalesce(cast(doc_id as varchar), 'null'), ':', md5(coalesce(text, '')))) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as number from d group by 1),
w as (select *, cast(({weights})[(number - 1) % {k} + 1] as double) as weight, source_size * {copies} as cap from s),
l as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, number rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(weight) over (order by cap / weight, number rows between current row and unbounded following) as weights from w),
t as (select source, source_size, number, least(cast(cap as double), (max(case when rest / weights * weight <= cap then rest / weights end) over ()) * weight) as target from l),
q as (select d.*, source_size, number, target, sum(size) over (partition by d.source order by key rows unbounded preceding) as sent
  from d join t on d.source is not distinct from t.source),
c as (select number, size, (sent + copy * source_size) / target as finish from q, range({copies}) r(copy) where size > 0),
f as (select *, sum(size) over (order by finish, number rows unbounded preceding) as filled from c),
e as (select finish, number as last_number from f where filled <= (select sum(size) from d) order by finish desc, number desc limit 1)
select doc_id, size, source_size, target, cast(({taken}) * size as bigint) as taken from q left join e on true"""


def repeats_sql() -> str:
    n = phrase_dedup.WINDOW
    return f"""
with d as (select doc_id, {WORDS} as w, row_number() over () as r from documents),
p as (select r, unnest(range(1, len(w) - {n} + 2)) as i, w from d),
h as (select r, i, md5(array_to_string(w[i:i + {n} - 1], ' ')) as h from p),
g as (select h from h group by 1 having count(*) > 1),
c as (select r, list(distinct k) as gone from (select r, unnest(range(i, i + {n})) as k from h join g using (h)) group by 1),
k as (select doc_id, w, case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end as kept from d left join c using (r))
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - len(kept) as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k"""
