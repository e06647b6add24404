"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (select r, doc_id, unnest(list_transform(generate_series(1, len(words) - 12), lambda i: {'p': i, 'k': array_to_string(words[i:i + 12], ' ')})) as x
  from w where len(words) >= 13),
least_doc as (select x.k as k, min(doc_id) as d from win group by 1),
gone as (select r, list(distinct q) as covered from (
  select win.r, unnest(generate_series(win.x.p, win.x.p + 12)) as q from win join least_doc f on win.x.k = f.k where f.d < win.doc_id) group by r)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(covered), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda v, i: not list_contains(coalesce(covered, []), i)), ' '), '')) as kept_sha256
from w left join gone using (r)"""

#: Kinds, patterns, the group that must be long enough, and how long.
KINDS = [
    ("assign", r'''(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)''', 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]


def _places(number: int, pattern: str, group: int, least: int) -> str:
    parts = f"""unnest(generate_series(1, len(regexp_extract_all(t, '{pattern}')))) as n, string_split_regex(t, '{pattern}') as gaps,
    regexp_extract_all(t, '{pattern}') as found, regexp_extract_all(t, '{pattern}', {group}) as groups"""
    return f"""select r, {number} as kind, stop - len(found[n]) as start, stop from (
  select *, list_sum(list_transform(gaps[1:n], lambda g: len(g))) + list_sum(list_transform(found[1:n], lambda g: len(g))) as stop
  from (select r, {parts} from d where regexp_matches(t, '{pattern}')))
where len(groups[n]) >= {least}"""


OP8 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as ({' union all '.join(_places(k, p, g, n) for k, (_, p, g, n) in enumerate(KINDS))}),
named as (select r, kind, start, ['assign', 'access', 'hex', 'pem', 'github', 'jwt'][kind + 1] || ':' || cast(start as bigint) || ':' || cast(stop as bigint) as span from s),
g as (select r, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c,
  string_agg(span, ',' order by start, kind) filter (kind < 3) as base, string_agg(span, ',' order by start, kind) as spans from named group by r)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans from d left join g using (r)"""


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP3 = f"""
with items as (select cast(item_id as varchar) as item, {_WORDS} as words from benchmark),
phrases as (select distinct item, least(len(words), 13) as size, array_to_string(words[i:i + 12], ' ') as phrase
  from (select *, unnest(generate_series(1, greatest(len(words) - 12, 1))) as i from items where len(words) > 0)),
d as (select row_number() over () as r, doc_id, {_WORDS} as words from documents),
w as (select r, size, i, array_to_string(words[i:i + size - 1], ' ') as phrase
  from (select r, words, size, unnest(generate_series(1, len(words) - size + 1)) as i from d, (select distinct size from phrases) where len(words) >= size)),
found as (select r, w.size, i, item from w join phrases using (size, phrase)),
hit as (select r, count(distinct place) as n from (select r, unnest(generate_series(i, i + size - 1)) as place from found) group by r),
names as (select r, count(*) as n, string_agg(item, ',' order by item) as listed from (select distinct r, item from found) group by r)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit, cast(coalesce(names.n, 0) as bigint) as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(words) as contaminated
from d left join hit using (r) left join names using (r)"""

OP5 = """
with copies as (select coalesce(page_id, -1) as seq, coalesce(url, '') as url, coalesce(html, '') as one,
    case when page_id % 97 = 13 then substr(html, 1, 100) || '?' || substr(html, 102) else html end as two, coalesce(page_id % 211 <> 7, true) as kept from pages),
records as (select cast(floor(seq / 1000.0) as bigint) as archive, seq, kept, one, coalesce(two, '') as two,
    strlen('WARC/1.0__WARC-Type: response__WARC-Target-URI: ' || url || '__Content-Length: ' || strlen(one) || '____' || one || '____') as size_1,
    strlen('WARC/1.0__WARC-Type: response__WARC-Target-URI: ' || url || '__Content-Length: ' || strlen(coalesce(two, '')) || '____' || coalesce(two, '') || '____') as size_2 from copies),
first as (select archive, seq, sum(size_1) over (partition by archive order by seq) as stop_1, size_1 from records),
second as (select archive, seq, sum(size_2) over (partition by archive order by seq) as stop_2, size_2 from records where kept)
select r.archive, r.seq, case when kept then 'changed' else 'missing' end as status, cast(null as varchar) as record, cast(stop_1 - f.size_1 as bigint) as start_1, cast(stop_1 as bigint) as stop_1,
  cast(stop_2 - s.size_2 as bigint) as start_2, cast(stop_2 as bigint) as stop_2
from records r join first f using (archive, seq) left join second s on s.archive = r.archive and s.seq = r.seq
where not kept or one <> two"""

#: Strings of 200 bytes are told apart by their MD5; the kept bytes are joined as hexadecimal digits.
OP10 = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
win as (select r, i, md5(b[i + 1:i + 200]) as k from (select r, b, unnest(range(0, octet_length(b) - 199)) as i from d where octet_length(b) >= 200)),
again as (select r, i from win join (select k from win group by k having count(*) > 1) using (k)),
ends as (select *, coalesce(i > lag(i) over (partition by r order by i) + 200, true) as opens from again),
runs as (select r, min(i) as a, max(i) + 200 as z from (select r, i, sum(cast(opens as int)) over (partition by r order by i) as n from ends) group by r, n),
cut as (select r, count(*) as n, sum(z - a) as gone, list(a order by a) as starts, list(z order by a) as stops from runs group by r)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans,
  sha256(case when n is null then b else unhex(array_to_string(list_transform(range(0, n + 1),
    lambda k: hex(b[case when k = 0 then 1 else stops[k] + 1 end:case when k = n then octet_length(b) else starts[k + 1] end])), '')) end) as kept_sha256
from d left join cut using (r)"""


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen(cast({value} as varchar)) || ':' || cast({value} as varchar) end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """The levels of the trees of ``leaves`` (grp, place, size, hash), and the children of each parent in one list."""
    return f"""{name} as (select 0 as level, grp, place, size, hash from {leaves} union all
  select level + 1, grp, place // 16, (any_value(size) + 15) // 16, sha256(string_agg(hash, '' order by place)) from {name} where size > 1 group by level, grp, place // 16),
{name}_runs as (select level, grp, place // 16 as parent, list(hash order by place) as run from {name} where size > 1 group by all),
{name}_steps as (select l.grp, l.place, list(array_to_string(run[1:slot], '') || '|' || array_to_string(run[slot + 2:], '') order by level) as steps
  from (select l.grp, l.place, r.level, r.run, l.place // cast(power(16, r.level) as bigint) % 16 as slot
    from {leaves} l join {name}_runs r on r.grp is not distinct from l.grp and r.parent = l.place // cast(power(16, r.level + 1) as bigint)) l group by all)"""


OP11 = f"""
with recursive byte as (select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
leaves as (select doc_id, source as grp, hash, claim, row_number() over (partition by source order by doc_id nulls first, hash) - 1 as place, count(*) over (partition by source) as size
  from (select doc_id, source, {_leaf("text")} as hash,
    case when xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0
      then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as claim from documents, byte)),
{_tree("t", "leaves")},
sources as (select 0 as grp, grp as name, hash, row_number() over (order by grp nulls first) - 1 as place, count(*) over () as size from t where size = 1),
{_tree("u", "sources")},
root as (select hash as root from u where size = 1),
p as (select doc_id, l.hash as leaf, coalesce(claim, l.hash) as claim, s.hash as subroot, root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) as steps
  from leaves l join sources s on s.name is not distinct from l.grp cross join root
  left join t_steps a on a.grp is not distinct from l.grp and a.place = l.place left join u_steps b on b.place = s.place)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) as proof_sha256, folded as folded_root, folded = root as verified
from (select *, list_reduce(list_concat([claim], steps), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) as folded from p)"""

OP13 = """
with v as (select row_number() over () as r, vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r as ar, a.id as anchor_id, a.label as own, b.r, b.id, b.label, cast(list_inner_product(a.v, b.v) as bigint) as score from v a join v b on a.id % 100 = 0 and a.r <> b.r),
p as (select * from s where label = own qualify row_number() over (partition by ar order by score desc, id) <= 5),
n as (select p.anchor_id, p.id as positive_id, cast(row_number() over (partition by p.ar, p.r order by s.score desc, s.id) as integer) as rank, s.id as negative_id,
  p.score as positive_score, s.score as negative_score from p join s on s.ar = p.ar and s.label <> p.own and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select * from n where rank <= 10"""


def llm_oracles() -> dict[str, str]:
    return {
        "op1_recompression_dedup": OP1,
        "op3_positional_decontamination": OP3,
        "op5_merkle_fixity_audit": OP5,
        "op8_blob_ledger": OP8,
        "op10_run_length_dedup": OP10,
        "op11_slot_manifest": OP11,
        "op13_slot_negatives": OP13,
    }
