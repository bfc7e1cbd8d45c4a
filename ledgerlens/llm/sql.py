"""DuckDB's SQL for the operators that SQL can express."""

from __future__ import annotations


def _crc_step(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


#: The table of the reflected CRC-32, by its rule.
_TABLE = "[" + ",".join(str(_crc_step(c)) for c in range(256)) + "]"


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, which are read off their hexadecimal digits."""
    at = f"list_transform(range(0, strlen({text})), lambda k: cast('0x' || substr(hex(encode({text})), 2 * k + 1, 2) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {at}), lambda a, b: xor(a >> 8, {_TABLE}[1 + (xor(a, b) & 255)])), 4294967295)"


LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every word is a feature, 10,000 buckets; a tenth of the documents with 20 words is drawn.
RESAMPLING = f"""with d as (select row_number() over () as r, doc_id, {WORDS} as words from documents),
b as (select {WORDS} as words from benchmark),
w as (select r, unnest(words) as word from d), v as (select unnest(words) as word from b),
k as (select word, {crc32("word")} % 10000 as bucket from (select word from w union select word from v)),
s as (select bucket, count(*) as s from w join k using (word) group by all), t as (select bucket, count(*) as t from v join k using (word) group by all),
g as (select bucket, cast(floor(1000 * ln(cast((coalesce(t, 0) + 1) * ((select count(*) from w) + 10000) as double) / ((s + 1) * ((select count(*) from v) + 10000)))) as bigint) as gain from s left join t using (bucket)),
x as (select r, count(*) as n, cast(sum(gain) as bigint) as weight from w join k using (word) join g using (bucket) group by r),
y as (select doc_id, r, coalesce(n, 0) as n_words, coalesce(weight, 0) as weight, cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from d left join x using (r)),
z as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from y),
o as (select r, row_number() over (order by score desc, doc_id nulls first, r) as place from z where n_words >= 20)
select doc_id, n_words as n_features, weight, score, case when place <= (select count(*) * 10 // 100 from o) then place end as rank, n_words from z left join o using (r)"""

#: A prefix is the text of its turns, each behind its lengths.
TRIE = f"""with recursive t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos from conversations where conv_id is not null),
v as (select c, {crc32("cast(c as varchar)")} % 4 as h from (select distinct c from t)),
r as (select v.c, t.pos, t.role, t.text from v join t on t.c = v.c - v.c % 20 and t.pos < v.h union all select v.c, t.pos, t.role, t.text from v join t on t.c = v.c and t.pos >= v.h),
o as (select c, row_number() over (partition by c order by pos) as depth, strlen(role) || ':' || role || strlen(text) || ':' || text as said, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from r),
p as (select c, depth, string_agg(said, '' order by depth) over (partition by c order by depth) as path, words from o union all select c, 0, '', 0 from v),
q as (select *, lag(path) over (partition by c order by depth) as up, depth = max(depth) over (partition by c) as ends from p),
n as (select path, depth, min(up) as up, min(c) as c, count(*) as n_convs, min(words) as words, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ends), '')) as ends_sha256 from q group by path, depth),
k as (select up as path, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by all),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (path, depth)),
u as (select path as below, depth as below_depth, path, depth, up, words, n_convs, n_children from m
  union all select u.below, u.below_depth, m.path, m.depth, m.up, u.words, u.n_convs, u.n_children from u join m on m.path = u.up and m.depth = u.depth - 1),
s as (select path, depth, cast(count_if(n_children = 0) as bigint) as n_leaves, sum((n_convs - 1) * words) as saved_tokens from u group by all)
select m.c as conv_id, m.depth, e.c as parent_conv_id, m.n_convs, m.n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, m.ends_sha256
from m join s using (path, depth) left join m e on e.path = m.up and e.depth = m.depth - 1"""
