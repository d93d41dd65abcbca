"""DuckDB SQL for those queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op8_warc"] = """
with p as (
  select page_id, coalesce(html, '') as body from pages
), d as (
  select page_id, strlen(body) as n, sha1(body) as h, sha256(body) as g from p
), o as (
  select g, max(page_id) as owner from d group by g
)
select d.page_id, cast(d.n as bigint) as payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      cast(1 + ((cast('0x' || substr(d.h, cast(1 + 5 * (i // 4) as int), 5) as bigint) >> cast(5 * (3 - i % 4) as int)) & 31) as int), 1)), lambda a, b: a || b) as payload_digest,
  case when d.page_id = o.owner then 'response' else 'revisit' end as record_type,
  case when d.page_id = o.owner then null else o.owner end as refers_to
from d join o using (g)
"""

ORACLES["op7_chat"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') as body,
    replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') as head
  from c
), f as (
  select *, sum(4 + length(head) + 2 + length(body) + 8) over w as upto,
    row_number() over w = count(*) over (partition by conv_id) as closing
  from e window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)
), g as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
    sum(case when role = 'assistant' or closing then upto else 0 end) as formatted_chars
  from f group by conv_id
)
select conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars
from g
"""

ORACLES["op1_mixing"] = r"""
with recursive counted as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')) as n,
    cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) % 256 as block
  from documents
), sums as (
  select source, block, sum(n) as tokens from counted group by source, block
), totals as (
  select source, sum(tokens) as tokens from sums group by source having sum(tokens) > 0
), shares as (
  select list(tokens / total) as q, count(*) as k, any_value(total) as total
  from totals, (select cast(sum(tokens) as double) as total from totals)
), entropy(i, low, high) as (
  select 0, cast(0 as double), cast(1 as double)
  union all
  select i + 1, case when h >= 0.97 * ln(k) then mid else low end, case when h >= 0.97 * ln(k) then high else mid end
  from (
    select i, low, high, mid, k,
      -list_sum(list_transform(p, lambda x: x / list_sum(p) * ln(x / list_sum(p)))) as h
    from (
      select i, low, high, (low + high) / 2 as mid, k, list_transform(q, lambda x: pow(x, (low + high) / 2)) as p
      from entropy, shares where i < 60))
), first_t as (
  select case when -list_sum(list_transform(q, lambda x: x * ln(x))) >= 0.97 * ln(k) then 1.0 else (select low from entropy where i = 60) end as t, q, k
  from shares
), repeats(i, low, high) as (
  select 0, cast(0 as double), cast(1 as double)
  union all
  select i + 1, case when most <= 4 then low else mid end, case when most <= 4 then mid else high end
  from (
    select i, low, high, (low + high) / 2 as mid,
      list_max(list_transform(q, lambda x: pow(x, (low + high) / 2) / x)) / list_sum(list_transform(q, lambda x: pow(x, (low + high) / 2))) as most
    from repeats, shares where i < 60)
), solved as (
  select case when list_max(list_transform(q, lambda x: pow(x, t) / x)) / list_sum(list_transform(q, lambda x: pow(x, t))) > 4
    then (select high from repeats where i = 60) else t end as t, q
  from first_t
), budgets as (
  select source, tokens, pow(tokens / total, t) / list_sum(list_transform(s.q, lambda x: pow(x, t))) as weight, total
  from totals, shares, solved s
), filled as (
  select *, cast(floor(weight * total + 1e-6) as bigint) as budget from budgets
), placed as (
  select s.source, s.block, s.tokens, f.weight, cast(f.budget // f.tokens as int) as epochs,
    md5('18:' || coalesce(s.source, '') || ':' || s.block) as turn,
    f.budget % f.tokens - coalesce(sum(s.tokens) over (partition by s.source order by md5('18:' || coalesce(s.source, '') || ':' || s.block), s.block rows between unbounded preceding and 1 preceding), 0) as spare
  from sums s join filled f on s.source is not distinct from f.source
), ranked as (
  select c.doc_id, c.source, cast(c.n as bigint) as n_tokens, coalesce(p.weight, 0) as weight,
    case when c.n > 0 then coalesce(p.epochs, 0) else 0 end as epochs, p.spare,
    p.turn || ':' || md5('19:' || coalesce(cast(c.doc_id as varchar), '')) as pos, c.n
    , sum(c.n) over (partition by c.source, c.block order by md5('19:' || coalesce(cast(c.doc_id as varchar), '')), c.doc_id, c.n rows unbounded preceding) as upto
  from counted c left join placed p on c.source is not distinct from p.source and c.block = p.block
)
select doc_id, source, n_tokens, round(weight, 9) as weight, epochs,
  case when n > 0 and spare > 0 and upto <= spare then pos end as last_rank,
  epochs + case when n > 0 and spare > 0 and upto <= spare then 1 else 0 end as copies
from ranked
"""

ORACLES["op10_substrings"] = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') as ws from documents
), win as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)
), first as (
  select g, min(doc_id) as earliest from win group by g
), covered as (
  select distinct doc_id, unnest(range(i, i + 13)) as p from win join first using (g) where earliest < doc_id
), words as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w
), kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by p) as body from words anti join covered using (doc_id, p) group by doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from w left join kept using (doc_id)
"""

ORACLES["op2_near_duplicates"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, case when len(ws) < 4 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 3], ' ') end as g
  from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) as i from w where len(ws) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all)
  join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)
), both_ways as (
  select a, b from links union all select b, a from links
), reach(doc_id, node) as (
  select doc_id, doc_id from documents
  union
  select r.doc_id, e.b from reach r join both_ways e on e.a = r.node
)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join (select doc_id, min(node) as component_id from reach group by doc_id) c using (doc_id) left join n using (doc_id)
"""

ORACLES["op6_neighbours"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), d as (
  select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(c.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as int) as rank, vec_id, score from d
qualify row_number() over (partition by query_id order by score, vec_id) <= 10
"""


def _url_pool(name: str, leaf: str, group: str) -> str:
    """CTEs ``name``: each segment of ``leaf`` against the pool of its group."""
    same = lambda x, y: " and ".join(f"{x}.{c} = {y}.{c}" for c in group.split(", "))
    out = ", ".join(f"l.{c}" for c in group.split(", "))
    return f"""
, {name}_node as (select {group}, seg, sum(n) as n, sum(labelled) as labelled, sum(bad) as bad from {leaf} group by all
), {name}_all as (select {group}, count(*) as k, sum(n) as all_n, sum(labelled) as all_labelled, sum(bad) as all_bad from {name}_node group by all
), {name}_pool as (select {group}, child, sum(n) as pool_n from {leaf} group by all
), {name}_kinds as (select {group}, count(*) as kinds from {name}_pool group by all
), {name}_far as (
  select {out}, l.seg, (sum(abs(l.n / s.n - p.pool_n / b.all_n) - p.pool_n / b.all_n) + 1) / 2 as distance,
    list_sort(list(l.child) filter (where l.n * 8 >= s.n)) as usual, any_value(s.n) as n, any_value(s.labelled) as labelled, any_value(k) as k, any_value(kinds) as kinds,
    coalesce(any_value(s.bad) / nullif(any_value(s.labelled), 0) - any_value(all_bad) / nullif(any_value(all_labelled), 0), 0) as gap
  from {leaf} l join {name}_pool p on {same("l", "p")} and l.child = p.child join {name}_node s on {same("l", "s")} and l.seg = s.seg
    join {name}_all b on {same("l", "b")} join {name}_kinds x on {same("l", "x")}
  group by all
), {name} as (
  select *, case when gap > bound then '+' when gap < -bound then '-' else '' end as side, distance <= sqrt((ln(40) + kinds * ln(2)) / (2 * n)) and abs(gap) <= bound as alike
  from (select *, sqrt(ln(40) / (2 * greatest(labelled, 1))) as bound from {name}_far)
)"""


def _url_oracle(depth: int = 6) -> str:
    """The path-template tree as SQL, a level of CTEs for each of ``depth`` segments (the tables' urls have 3)."""
    parts = """
with raw as (
  select page_id, url, regexp_extract(coalesce(url, ''), '/([0-9]{1,18})(?:\\.[a-z]+)?/?(?:[?#].*)?$', 1) as number,
    split_part(split_part(case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '?', 1), '#', 1) as place
  from pages
), hosted as (
  select *, translate(split_part(place, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(place, 1 + length(split_part(place, '/', 1))) as path from raw
), shaped as (
  select *, list_transform(string_split(path, '/')[2:], lambda s: regexp_replace(case when regexp_full_match(s, '[0-9a-fA-F-]{8,}') and regexp_matches(s, '[0-9]') and regexp_matches(s, '[a-fA-F]') then '{h}' else s end, '[0-9]+', '{n}', 'g')) as shape
  from hosted
), quality as (
  select doc_id, case when max(quality) = 0 then 1 else 0 end as bad from labels where quality is not null and doc_id is not null group by doc_id
), seen as (
  select host, shape, cast(null as int) as bad from shaped
  union all select host, shape, q.bad from shaped s join quality q on s.number <> '' and cast(s.number as bigint) = q.doc_id
), t0 as (
  select host, shape, count(*) as n, count(bad) as labelled, cast(coalesce(sum(bad), 0) as bigint) as bad, '' as prefix from seen group by host, shape
)"""
    for d in range(1, depth + 1):
        was = f"t{d - 1}"
        parts += f"""
, leaf{d} as (
  select host, prefix, shape[{d}] as seg, case when len(shape) > {d} then shape[{d + 1}] else '$' end as child, sum(n) as n, sum(labelled) as labelled, sum(bad) as bad
  from {was} where len(shape) >= {d} group by all
){_url_pool(f"among{d}", f"leaf{d}", "host, prefix")}
, rest{d} as (
  select l.*, '(' || array_to_string(usual, '|') || ')' || side as family from leaf{d} l join among{d} a on l.host = a.host and l.prefix = a.prefix and l.seg = a.seg where k > 1 and not alike
){_url_pool(f"within{d}", f"rest{d}", "host, prefix, family")}
, wild{d} as (
  select host, prefix, seg, '*' as wild from among{d} where k > 1 and alike
  union all select host, prefix, seg, '*' || family from within{d} where k > 1 and alike
), t{d} as (
  select t.host, t.shape, t.n, t.labelled, t.bad, case when len(t.shape) < {d} then t.prefix else t.prefix || '/' || coalesce(w.wild, t.shape[{d}]) end as prefix
  from {was} t left join wild{d} w on w.host = t.host and w.prefix = t.prefix and len(t.shape) >= {d} and w.seg = t.shape[{d}]
)"""
    # Below, no two shapes of these tables share a prefix: what is left of a path stays as it is.
    parts += f"""
, done as (select host, shape, n, labelled, bad, prefix || case when len(shape) > {depth} then '/' || array_to_string(shape[{depth + 1}:], '/') else '' end as prefix from t{depth})"""
    last = "done"
    return (
        parts
        + f"""
, prior as (select (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(labelled), 0) + 2.0) as prior from {last}
), hosts as (select host, (sum(bad) + 10.0 * any_value(prior)) / (sum(labelled) + 10.0) as host_rate from {last}, prior group by host
), rates as (select host, prefix, (sum(bad) + 10.0 * any_value(host_rate)) / (sum(labelled) + 10.0) as bad_rate from {last} join hosts using (host) group by host, prefix
), rules(verdict, rule_host, rule_path) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), tree as (select t.host, t.shape, t.prefix as template, r.bad_rate from {last} t join rates r using (host, prefix)
), judged as (
  select s.page_id, s.host, s.path, t.template, t.bad_rate,
    (select arg_max(struct_pack(rule := rule_host || rule_path, verdict := r.verdict), length(rule_host || rule_path)) from rules r
     where (s.host = rule_host or ends_with(s.host, '.' || rule_host)) and starts_with(s.path, rule_path)) as r
  from shaped s join tree t on t.host = s.host and t.shape = s.shape
)
select page_id, host, path, r.rule as rule, coalesce(r.verdict, case when bad_rate >= 0.5 then 'block' else 'allow' end) as verdict, template, round(bad_rate, 9) as bad_rate from judged
"""
    )


ORACLES["op4_url_templates"] = _url_oracle()
