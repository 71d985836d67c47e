"""DuckDB SQL for those opN queries that SQL can express."""

from __future__ import annotations

from sigspark.llm import sharding

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, with the table t of crc."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast('0x' || x as bigint))"
    return f"xor(list_reduce({data}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"


_CRC = "crc as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, n)) as t)"


def _feistel(x: str, half: str, seed: int, a: str, k: str) -> str:
    """The permutation with both halves packed in one integer."""
    keys, mask, m = sharding.round_keys(seed), f"((1::bigint << {half}) - 1)", sharding._M
    right = f"({a} & {mask})"
    t = f"((({right} + {k}) % {m} * {sharding._A} + {sharding._C}) % {m})"
    mixed = f"((xor({t}, {t} >> 13) * {sharding._A2} % {m}) >> 7)"
    return f"list_reduce({keys}::bigint[], lambda {a}, {k}: ({right} << {half}) | xor({a} >> {half}, {mixed} & {mask}), {x})"


OP1 = f"""
with {_CRC},
rows as (select doc_id, strlen(coalesce(text, ''))::bigint + 1 as size, {_crc32("coalesce(text, '')")} as text_crc32, {_crc32("coalesce(doc_id::varchar, '')")} as id_crc from documents, crc),
numbered as (select *, count(*) over () as n, row_number() over (order by (id_crc + text_crc32) % {sharding.BUCKETS}, doc_id nulls first, text_crc32, size) - 1 as x from rows),
halves as (select *, (length(bin(n - 1)) + 1) // 2 as half from numbered),
first as (select *, {_feistel("x", "half", 20, "a", "k")} as p from halves),
placed as (select *, list_reduce(range({sharding.WALK}), lambda p, i: case when p < n then p else {_feistel("p", "half", 20, "a2", "k2")} end, p) as place from first)
select doc_id, size, text_crc32::bigint as text_crc32, 'rows' as law, (place % 8)::int as shard, (place // 8)::bigint as slot, null::int as grown_shard from placed
"""

OP4 = rf"""
with recursive words as (select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
shingled as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
sets as (select *, sha256(array_to_string(list_sort(s), chr(10))) as key from shingled),
classes as (select min(doc_id) as node, len(any_value(s)) as n, any_value(s) as s, key from sets where len(s) > 0 group by key),
every as (select node, n, unnest(s) as x from classes),
items as (select * from every where x in (select x from every group by x having count(*) > 1)),
links as (select a.node as a, b.node as b from items a join items b on a.x = b.x and a.node < b.node group by a.node, b.node, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways as (select a, b from links union select b, a from links),
reach as (select node as a, node as b from classes union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
roots as (select a as node, min(b) as root from reach group by a),
member as (select sets.doc_id, len(sets.s) as n, classes.node from sets left join classes on len(sets.s) > 0 and sets.key = classes.key)
select doc_id, n::bigint as n_shingles, coalesce(root, doc_id) as component_id, doc_id = coalesce(root, doc_id) as kept from member left join roots on member.node = roots.node
"""

_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(h, (i // 4) * 5 + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '')"

OP6 = f"""
with hashed as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(encode(coalesce(html, ''))) as h from pages),
first as (select h, max(page_id) as response from hashed group by h)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = response then 'response' else 'revisit' end as record_type, case when page_id <> response then response end as refers_to
from (select hashed.*, response from hashed join first on hashed.h = first.h)
"""


def _terms(text: str) -> str:
    """ASCII letters and digits, and all other characters, as terms; A-Z lower-cased."""
    return rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


OP11 = f"""
with terms as (select row_number() over () as r, doc_id, {_terms("coalesce(text, '')")} as t from documents),
sized as (select r, doc_id, t, len(t)::bigint as n from terms),
total as (select count(*) filter (n > 0)::bigint as n_docs, sum(n)::bigint as n_terms from sized),
posting as (select r, doc_id, n, term, count(*)::bigint as tf from (select r, doc_id, n, unnest(t) as term from sized) group by r, doc_id, n, term),
weight as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from posting, total group by term),
item as (select distinct item_id, unnest({_terms("coalesce(text, '')")}) as term from benchmark),
scored as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score from item join weight using (term) join posting using (term), total group by item_id, r, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last, r)::int as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

_PIECE_WORDS = r"list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'), lambda p: regexp_extract_all(p, '[^\x20\x09]+'))"

OP13 = f"""
with piece as (select coalesce(lang, 'und') as lang, unnest({_PIECE_WORDS}) as w from documents),
run as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from piece, (select unnest(range(1, 6)) as k) where len(w) >= k),
f as (select lang, k, phrase, count(*)::bigint as f from run group by lang, k, phrase),
total as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
candidate as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 100),
cut as (select lang, k, phrase, a, c, array_to_string(w[1:c], ' ') as first, array_to_string(w[c + 1:], ' ') as last from candidate, (select unnest(range(1, 5)) as c) where c < k),
scored as (select cut.lang, cut.phrase, a, c, l.f as l, r.f as r, n, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint as score from cut join f l on cut.lang = l.lang and l.k = c and l.phrase = first join f r on cut.lang = r.lang and r.k = cut.k - c and r.phrase = last join total on total.lang = cut.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inner_run as (select lang, a as fl, array_to_string(w[i:i + m - 1], ' ') as phrase from candidate, (select unnest(range(2, 5)) as m), (select unnest(range(1, 5)) as i) where m < k and i + m - 1 <= k),
dropped as (select distinct c.lang, c.phrase from candidate c join inner_run i on c.lang = i.lang and c.phrase = i.phrase and 100 * fl >= 100 * c.a),
kept as (select * from lowest where not exists (select 1 from dropped d where d.lang = lowest.lang and d.phrase = lowest.phrase)),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from kept)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
