r"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') as w from documents),
b as (select item_id, row_number() over () as r, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, pos, pos + 9), ' ') as win
       from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as pos from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select r, pos, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') as win
       from (select r, w, n, unnest(range(1, len(w) - n + 2)) as pos from d, sizes where len(w) >= n)),
hits as (select distinct r, pos, dw.n, win, item_id from dw join bw using (win) where dw.n = bw.n),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(pos, pos + n)) as p from (select distinct r, pos, n from hits)) group by r),
items as (select r, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct r, cast(item_id as varchar) as i from hits where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""

OP6 = r"""
with s as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
           md5('7|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as draw from documents),
src as (select source, count(*) as n, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as rank from s group by source),
weighed as (select *, case rank % 3 when 0 then 3 when 1 then 1 else 2 end as w from src),
units as (select *, (1.5 * sum(source_size) over () - coalesce(sum(2 * source_size) over below, 0)) / (sum(w) over () - coalesce(sum(w) over below, 0)) as unit
          from weighed window below as (order by 2.0 * source_size / w, rank rows between unbounded preceding and 1 preceding)),
filled as (select *, unit > 2.0 * source_size / w as capped from units),
goals as (select source, n, rank, source_size, case when capped then cast(2 * source_size as double) else cast(w as double) * max(case when not capped then unit end) over () end as target,
          greatest(1, least(16, min(case when source_size > 0 then source_size // 64 end) over ())) as block, greatest(1, cast(ceil(n / greatest(1000.0, ceil(sum(n) over () / 100000.0))) as bigint)) as shards from filled),
dealt as (select s.*, rank, block, source_size, target, cast('0x' || substr(md5('7|' || draw), 1, 8) as bigint) % shards as shard
          from s join goals g on s.source is not distinct from g.source),
held as (select rank, shard, any_value(block) as block, any_value(target) as target, sum(size) as words, cast(ceil(sum(size) / any_value(block)) as bigint) as nb from dealt group by rank, shard),
parties as (select rank, any_value(target) as target, 2 * sum(nb) as cap from held group by rank),
seats as (select rank, count(*) as q from (select rank, row_number() over (order by target / (2 * k + 1) desc, rank) as place
          from (select rank, target, unnest(range(0, cast(cap as bigint))) as k from parties where target > 0))
          where place <= (select floor(sum(target) / any_value(block) + 0.5) from goals) group by rank),
quotas as (select rank, shard, nb, count(*) filter (place <= q) as quota from (
             select h.rank, shard, nb, coalesce(q, 0) as q, row_number() over (partition by h.rank order by words / (2 * k + 1) desc, shard) as place
             from (select *, unnest(range(0, 2 * nb)) as k from held where nb > 0) h left join seats using (rank)) group by rank, shard, nb),
laid as (select d.*, coalesce(sum(size) over (partition by rank, shard order by draw, size rows between unbounded preceding and 1 preceding), 0) as start from dealt d),
full_ as (select l.*, q.quota, q.nb, cast('0x' || substr(md5('7|' || l.rank || '|' || l.shard), 1, 8) as bigint) % q.nb as chosen from laid l left join quotas q on l.rank = q.rank and l.shard = q.shard),
ends as (select *, start // block as j0, (start + size) // block as j1, quota % nb as more from full_),
upto as (select *,
  (quota // nb) * start + ((j0 * more + chosen) // nb) * block + (((j0 + 1) * more + chosen) // nb - (j0 * more + chosen) // nb) * (start - j0 * block) as c0,
  (quota // nb) * (start + size) + ((j1 * more + chosen) // nb) * block + (((j1 + 1) * more + chosen) // nb - (j1 * more + chosen) // nb) * (start + size - j1 * block) as c1 from ends)
select doc_id, size, source_size, target, cast(coalesce(c1 - c0, 0) as bigint) as taken from upto
"""

OP4 = """
with d as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as x from documents),
win as (select r, pos, md5(substr(x, 2 * pos - 1, 800)) as h from (select r, x, unnest(range(1, length(x) // 2 - 398)) as pos from d where length(x) >= 800)),
hit as (select r, pos from win where h in (select h from win group by h having count(*) > 1)),
marked as (select r, pos, case when pos <= lag(pos) over (partition by r order by pos) + 400 then 0 else 1 end as fresh from hit),
runs as (select r, min(pos) as a, max(pos) + 400 as b from (select r, pos, sum(fresh) over (partition by r order by pos rows unbounded preceding) as run from marked) group by r, run),
before as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 1) as free from runs),
kept as (select before.r, string_agg(substr(any_x.x, 2 * free - 1, 2 * (a - free)), '' order by a) as head, max(b) as free, sum(b - a) as n_removed, count(*) as n_spans
         from before join d as any_x on before.r = any_x.r group by before.r)
select doc_id, length(x) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(case when n_spans is null then x else head || substr(x, 2 * free - 1) end)) as kept_sha256
from d left join kept using (r)
"""

OP10 = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 49), ' ')) as h from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as pos from d where len(w) >= 50)),
least as (select h, min(coalesce(doc_id, 9223372036854775807)) as first from win group by h),
gone as (select distinct r, unnest(range(pos, pos + 50)) as p from win join least using (h) where coalesce(doc_id, 9223372036854775807) > first),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select r, string_agg(word, ' ' order by p) as text from words anti join gone using (r, p) group by r),
lost as (select r, count(*) as n from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join lost using (r) left join kept using (r)
"""

OP13 = r"""
with d as (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select r, doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as pos from d),
keys as (select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (select key, max(doc_id) as last from keys where length(key) >= 40 group by key having count(distinct r) >= 5),
judged as (select keys.*, last is not null and doc_id is distinct from last as gone from keys left join shared using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by r
"""

_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"

OP11 = rf"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, {_CRC} as h from documents),
g as (select doc_id, r, w, h % 10 = 0 and len(w) > 0 as hit, case when len(w) > 0 then (h // 10) % len(w) end as a, 3 + (h // 10) % 8 as k from d),
t as (select doc_id, r, case when hit then list_transform(range(0, len(w)), lambda i: case when i >= a then w[a + (i - a) % (1 + (len(w) - a) // k) + 1] else w[i + 1] end) else w end as w from g),
n as (select r, len(w) as n from t),
words as (select r, unnest(w) as word, unnest(range(0, len(w))) as i from t),
pairs as (select x.r, x.i, y.i - x.i as p from words x join words y on x.r = y.r and x.word = y.word and y.i > x.i join n on n.r = x.r where 4 * (y.i - x.i) <= n.n),
isles as (select r, p, i, i - row_number() over (partition by r, p order by i) as isle from pairs),
stretches as (select r, p, min(i) as a, max(i) + 1 + p as b from isles group by r, p, isle having count(*) + p >= greatest(6, 4 * p)),
runs as (select r, a, b, min(p) as p from stretches group by r, a, b),
sums as (select r, count(*) as n_runs, string_agg(a || ',' || (b - a) || ',' || p || chr(10), '' order by a, p) as listed from runs group by r),
best as (select r, a, b, p from runs qualify row_number() over (partition by r order by cast(b - a as double) / p desc, a, p) = 1),
gone as (select distinct r, unnest(range(a + p, b)) as i from runs),
kept as (select r, string_agg(word, ' ' order by i) as s from words anti join gone using (r, i) group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, a as start, b - a as length, p as period, 1000 * (b - a) // p as exponent_milli,
       sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(s, '')) as collapsed_sha256
from t left join sums using (r) left join best using (r) left join kept using (r)
"""


def _op12() -> str:
    step = """
near{n} as (select v.r, v.p, arg_min(c.k, c.k + 64 * list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))) as k,
                   min(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))) as d
            from parts v join c{n} c using (p) group by v.r, v.p)"""
    mean = """,
sums{n} as (select p, k, i, cast(floor(sum(x) / count(*)) as bigint) as m from (select near{n}.p, k, unnest(x) as x, unnest(range(1, len(x) + 1)) as i from near{n} join parts using (r, p)) group by p, k, i),
means{n} as (select p, k, list(m order by i) as m from sums{n} group by p, k),
c{next} as (select p, k, coalesce(m, x) as x from c{n} left join means{n} using (p, k)),"""
    return (
        """
with e as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
           from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select r, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) as x from (select r, v, unnest(range(0, 16)) as p from e)),
c0 as (select p, k, x from parts join (select r, row_number() over (order by vec_id, v) - 1 as k from e qualify k < 64) using (r)),"""
        + step.format(n=0) + mean.format(n=0, next=1) + step.format(n=1) + mean.format(n=1, next=2) + step.format(n=2)
        + """,
coded as (select vec_id, label, string_agg(printf('%02x', k), '' order by p) as code, cast(sum(d) as bigint) as error from near2 join e using (r) group by r, vec_id, label),
book as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, k)) as codebooks_sha256 from c2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, book
"""
    )


ORACLES: dict[str, str] = {
    "op1_decontaminate": OP1,
    "op4_suffix_array": OP4,
    "op6_mixing": OP6,
    "op10_automaton": OP10,
    "op11_periodic": OP11,
    "op12_vector_codes": _op12(),
    "op13_line_dedup": OP13,
}
