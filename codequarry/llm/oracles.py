"""DuckDB SQL with the rows of the operators' queries, where SQL can give them.

Each is written from the definition of the result, not from the way the
operator gets it: all pairs by an inverted index instead of hashing, all windows
instead of anchors, all quotients instead of rounding first.
"""

from __future__ import annotations

import math

from codequarry.llm import mixing, secrets, urlfilter

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""with recursive w as (select doc_id, {_WORDS.format(_LOWER)} as w from documents),
g as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
l as (select a, b from e union select b, a from e),
r(doc_id, root) as (select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on l.a = r.root),
c as (select doc_id, min(root) as component_id from r group by 1)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, c.doc_id = component_id as kept from c left join n using (doc_id)"""

OP2 = """with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, unnest(range(0, greatest(len(h) // 2 - 199, 0))) as i, h from t),
m as (select doc_id, i, md5(substr(h, (2 * i + 1)::int, 400)) as k from p),
d as (select doc_id, i from m qualify count(*) over (partition by k) > 1),
s as (select doc_id, i, (i > lag(i) over o + 200 or lag(i) over o is null)::int as first from d window o as (partition by doc_id order by i)),
v as (select doc_id, i, sum(first) over (partition by doc_id order by i) as run from s),
r as (select doc_id, run, min(i) as a, max(i) + 200 as b from v group by 1, 2),
q as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from r),
k as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, max(b) as last, string_agg(substr(h, (2 * before + 1)::int, (2 * (a - before))::int), '' order by a) as head from q join t using (doc_id) group by 1)
select t.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
 sha256(unhex(case when k.doc_id is null then h else head || substr(h, (2 * last + 1)::int) end)) as kept_sha256 from t left join k using (doc_id)"""


def _rank(name: str, edges: str, seed: str) -> str:
    """Personalised PageRank as a sum over walks, scaled to 1."""
    d, rounds = urlfilter.DAMPING, math.ceil(math.log(urlfilter.TOLERANCE * (1 - urlfilter.DAMPING)) / math.log(urlfilter.DAMPING))
    return ", ".join([
        f"{name}_out as (select src, sum(weight) as total from {edges} group by 1)", f"{name}_steps as (select e.src, e.dst, e.weight / o.total as share from {edges} e join {name}_out o using (src))",
        f"{name}_walk(k, host, part) as (select 0, host, {seed} / sum({seed}) over () from hosts where {seed} > 0 union all select any_value(k) + 1, dst, sum(part * share) * {d} from {name}_walk join {name}_steps on host = src where k < {rounds} group by dst)",
        f"{name} as (select host, round(sum(part) / (select sum(part) from {name}_walk), 12) as score from {name}_walk group by 1)",
    ])


_RULE = " ".join(
    f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{{{k}}}'" for k, r in sorted(enumerate(urlfilter.RULES), key=lambda x: -len(x[1].pattern))
)
_HOST = "translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3 = f"""with recursive a as (select page_id, {_HOST.format("url")} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
b as (select *, case {_RULE.format(*[r.pattern for r in urlfilter.RULES])} end as rule, case {_RULE.format(*[r.verdict for r in urlfilter.RULES])} end as verdict from a),
hosts as (select host, count_if(verdict = 'allow')::double as allowed, count_if(verdict = 'block')::double as blocked from b where host <> '' group by 1),
x as (select {_HOST.format("url")} as src, regexp_replace(unnest(regexp_extract_all(coalesce(html, ''), '{urlfilter.LINK.replace(chr(39), chr(39) * 2)}', 1)), '^//', 'http://') as href from pages),
e as (select src, {_HOST.format("href")} as dst, count(*)::double as weight from x where src <> {_HOST.format("href")} and src <> '' and {_HOST.format("href")} <> '' group by 1, 2),
back as (select dst as src, src as dst, weight from e), {_rank("t", "e", "allowed")}, {_rank("u", "back", "blocked")}
select page_id, b.host, path, rule, coalesce(verdict, case when coalesce(u.score, 0) > coalesce(t.score, 0) then 'block' else 'allow' end) as verdict
from b left join t on t.host = b.host left join u on u.host = b.host"""

OP6 = """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type, case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from p left join f using (payload_digest)"""

_SEED = mixing.SEED
_NUMBER = "('0x' || substr(md5({0}), 1, 15))::bigint"
OP8 = rf"""with z as (select doc_id, source, len({_WORDS.format("text")})::bigint as size, {_NUMBER.format(f"concat_ws(':', '{_SEED}', doc_id, coalesce(text, ''))")} as spot from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from z group by 1),
o as (select *, source_size * {mixing.MOST} as cap, sum(source_size) over () as total from s),
l as (select *, (total - coalesce(sum(cap) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level from o window b as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(cap, weight * (select arg_min(level, cap / weight) from l where level * weight <= cap))::double as target from l),
n as (select *, round(sum(target) over () / {mixing.BLOCK})::bigint as seats from t),
q as (select source, any_value(source_size) as source_size, any_value(target) as target, count(r) as quota from n left join (
  select source as sc, row_number() over (order by target / (2 * j + 1) desc, source nulls last) as r from n, range(0, (select max(seats) from n)) x(j) where j <= target / {mixing.BLOCK} + 2) w on sc is not distinct from source and r <= seats group by 1),
d as (select z.*, source_size, target, quota, spot % greatest(ceil(source_size / {mixing.SHARD})::bigint, 1) as shard from z join q on z.source is not distinct from q.source),
h as (select source, shard, sum(size)::bigint as words, any_value(quota) as quota, sum(sum(size)) over (partition by source) as of_all from d group by 1, 2),
k as (select source, shard, any_value(words) as words, count(r) as quota from h left join (
  select source as sc, shard as sh, row_number() over (partition by source order by words / (2 * j + 1) desc, shard) as r from h, range(0, (select max(quota) from h)) x(j) where words > 0 and j <= words * quota / of_all + 2) w on sc is not distinct from source and sh = shard and r <= h.quota group by 1, 2),
a as (select source, shard, words, least(quota * {mixing.BLOCK}, words * {mixing.MOST})::bigint as take, case when words > 0 then {_NUMBER.format(f"concat_ws(':', '{_SEED}', source, shard)")} % ceil(words / {mixing.BLOCK})::bigint * {mixing.BLOCK} else 0 end as start from k),
c as (select d.*, sum(size) over (partition by d.source, d.shard order by spot, doc_id, size rows unbounded preceding) as hi, words, take, start, take % greatest(words, 1) as rest from d join a on d.source is not distinct from a.source and d.shard = a.shard)
select doc_id, source, size, source_size, target, (size * (take // greatest(words, 1)) + greatest(0, least(hi, start + rest) - greatest(hi - size, start)) + greatest(0, least(hi, start - words + rest) - greatest(hi - size, start - words)))::bigint as taken from c"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""select doc_id, {rank} as rank, '{kind}' as kind, a.i, (list_sum(list_transform(gaps[1:a.i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:a.i - 1], lambda x: len(x))), 0))::bigint as start, found[a.i] as found
  from (select doc_id, string_split_regex(coalesce(text, ''), '{p}') as gaps, regexp_extract_all(coalesce(text, ''), '{p}') as found, regexp_extract_all(coalesce(text, ''), '{p}', {group}) as part from documents), unnest(range(1, len(found) + 1)) a(i) where len(part[a.i]) >= {least}"""


def _regex(p: str) -> str:
    return p.replace("'", "''")


_W = secrets.WINDOW
_MIXED = _regex(secrets.MIXED)
#: A window counts unless it holds a placeholder or shares a character with a ruler.
_RULED = " or ".join(f"regexp_matches(substr(found, (greatest(k - {len(r) - 1}, 0) + 1)::int, ({_W} + {len(r) - 1} + least(k, {len(r) - 1}))::int), '(?i){r}')" for r in secrets.RULERS)
_ENTROPY = [_spans("entropy", 3, p, 0, _W) for p in (secrets.CANDIDATE, *secrets.HEX_CANDIDATES, secrets.LETTERS)]
OP9 = f"""with b as ({_spans("assign", 0, secrets.ASSIGN, 2, secrets.ASSIGN_LEAST)} union all {_spans("access", 1, secrets.ACCESS, 0, secrets.ACCESS_LEAST)} union all {_spans("hex", 2, secrets.HEX, 0, secrets.HEX_LEAST)}),
base as (select doc_id, rank, kind, start, start + len(found) as stop from b),
c as (select doc_id, start, start + len(found) as stop, found, regexp_matches(found, '{_MIXED}') as mixed from ({_ENTROPY[0]}) where regexp_matches(found, '{_MIXED}') or regexp_matches(found, '{secrets.LETTERS}')),
free as (select kind, doc_id, start, found from (select 'hex' as kind, * exclude (kind) from ({_ENTROPY[1]} union all {_ENTROPY[2]}) where regexp_matches(found, '{_MIXED}') union all select 'letters' as kind, * exclude (kind) from ({_ENTROPY[3]})) t
  where not exists (select 1 from base where base.doc_id = t.doc_id and base.start <= t.start and t.start + len(t.found) <= base.stop)),
runs as (select 'key' as kind, doc_id, start, found, start as owner from c where mixed and not regexp_full_match(found, '[0-9a-f]+|[0-9A-F]+')
  union all select kind, free.doc_id, free.start, free.found, c.start from free join c on c.doc_id = free.doc_id and c.start <= free.start and free.start + len(free.found) <= c.stop where kind = 'hex' or not mixed),
w as (select doc_id, owner, kind, start, found, k.k as k, unnest(string_split(substr(case when kind = 'hex' then lower(found) else found end, (k.k + 1)::int, {_W}), '')) as ch from runs, unnest(range(0, len(found) - {_W - 1})) k(k)),
f as (select doc_id, owner, kind, start, found, k, ch, count(*) as n from w group by all),
h as (select doc_id, owner, kind, start, found, k, {math.log2(_W)!r} - sum(n * log2(n)) / {_W}.0 as bits from f group by all),
hit as (select doc_id, owner, kind, start, found, min(k) as lo, max(k) as hi from h where bits >= case when kind = 'hex' then {secrets.CLASSES["hex"][1]} else {secrets.CLASSES["key"][1]} end
  and not regexp_matches(substr(found, (k + 1)::int, {_W}), '{_regex(secrets.PLACEHOLDER)}') and not ({_RULED}) group by all),
part as (select doc_id, owner, min(case when kind = 'hex' then start else start + lo end) as start, max(case when kind = 'hex' then start + len(found) else start + hi + {_W} end) as stop from hit group by 1, 2),
more as (select doc_id, 3 as rank, 'entropy' as kind, start, stop from part where not exists (select 1 from base where base.doc_id = part.doc_id and base.start <= part.start and part.stop <= base.stop)),
every as (select * from base union all select * from more),
g as (select doc_id, count_if(rank = 0) as n_assign, count_if(rank = 1) as n_access, count_if(rank = 2) as n_hex, count_if(rank = 3) as n_entropy,
  string_agg(case when rank < 3 then kind || ':' || start || ':' || stop end, ',' order by start, rank) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans from every group by 1)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_entropy, 0)::bigint as n_entropy from documents d left join g using (doc_id)"""

ORACLE = {"op1_minhash_near_dedup": OP1, "op2_suffix_dedup": OP2, "op3_url_filter": OP3, "op6_warc": OP6, "op8_source_mixing": OP8, "op9_secret_scan": OP9}
