"""DuckDB SQL of operators 11 to 13: other formulations of the same results, put together from repeated parts."""

from __future__ import annotations


def _crc(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384), xor(c & 255, b))"
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::bigint), lambda c, b: xor(c >> 8, {byte}), 4294967295), 4294967295)"


def _climb(name: str, key: str, levels: int) -> list[str]:
    """From ``{name}0`` (key, r, n, h) and ``{name}p0`` (key, id columns in ``x``, r, n, node, proof) up to ``{name}{levels}``."""
    out = []
    for j in range(levels):
        out.append(f"{name}r{j} as (select {key}, r // 3 as p, any_value(n) as n, list(h order by r) as hs from {name}{j} group by 1, 2)")
        out.append(f"{name}{j + 1} as (select {key}, p as r, (n + 2) // 3 as n, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h from {name}r{j})")
        step = f"select w.{key}, w.x, w.r // 3 as r, (w.n + 2) // 3 as n, case when w.n > 1 then array_to_string(q.hs[1:w.r % 3], '') else '' end as b, case when w.n > 1 then array_to_string(q.hs[w.r % 3 + 2:], '') else '' end as a, w.n as m, w.node, w.proof from {name}p{j} w join {name}r{j} q on w.{key} is not distinct from q.{key} and w.r // 3 = q.p"
        out.append(f"{name}p{j + 1} as (select {key}, x, r, n, case when m > 1 then sha256(b || node || a) else node end as node, proof || b || a as proof from ({step}))")
    return out


def _manifest(levels: int = 12) -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    number = "row_number() over (partition by source order by doc_id nulls first, leaf) - 1"
    parts = [
        f"d as (select doc_id, source, {leaf('text')} as leaf, case when coalesce({_crc('doc_id::varchar')} % 2 = 0, false) then {leaf('''replace(text, chr(10), '')''')} end as other from documents)",
        f"s0 as (select source, doc_id, leaf as h, coalesce(other, leaf) as given, {number} as r, count(*) over (partition by source) as n from d)",
        "sp0 as (select source, {'doc_id': doc_id, 'leaf': h} as x, r, n, given as node, '' as proof from s0)",
        *_climb("s", "source", levels),
        f"t0 as (select 0 as k, source, h, row_number() over (order by source nulls first) - 1 as r, count(*) over () as n from s{levels})",
        f"tp0 as (select 0 as k, {{'doc_id': p.x.doc_id, 'leaf': p.x.leaf, 'subroot': t.h}} as x, t.r, t.n, p.node, p.proof from sp{levels} p join t0 t on p.source is not distinct from t.source)",
        *_climb("t", "k", levels),
    ]
    return "with " + ",\n".join(parts) + f"\nselect x.doc_id as doc_id, x.leaf as leaf, x.subroot as subroot, h as root, sha256(proof) as proof_sha256, node as folded_root, node = h as verified from tp{levels}, t{levels}"


OP11_SQL = _manifest()

#: Five hexadecimal digits of the SHA-1 are four of the 32 letters.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '')"

OP12_SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages
), m as (select html, max(page_id) as top, count(*) as n from p group by 1
), x as (select page_id, strlen(html) as payload_bytes, sha1(html) as s, case when n > 1 and page_id is distinct from top then top end as refers_to from p join m using (html))
select page_id, payload_bytes::bigint as payload_bytes, {_BASE32} as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from x
"""


def _repair() -> str:
    """Forwards: for each state the least (cost, audit) of all edits so far, with what is repaired."""
    far = 1_000_000_000
    item = lambda cost, audit, out: f"{{'c': ({cost})::bigint, 'a': {audit}, 'o': {out}}}"
    line = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    insert = lambda x, role: item(f"{x}.c + 3", f"{x}.a || 'I'", f"{x}.o || {line(repr(role), repr(''))}")
    delete = lambda x: item(f"{x}.c + 4", f"{x}.a || 'D'", f"{x}.o")
    own = f"(case when r.gone then {far} when r.cut then 3 else 0 end)"
    rerole = lambda x, role: item(f"{x}.c + 3 + {own}", f"{x}.a || 'R'", f"{x}.o || {line(repr(role), 'r.text')}")
    keep = lambda x, i: item(f"{x}.c + {own} + case when r.role[1:1] = '{i}' then 0 else {far} end", f"{x}.a || 'K'", f"{x}.o || {line('r.role', 'r.text')}")
    # z, s, u, a: the states
    row = {
        "z": delete("b.z"),
        "s": f"least({delete('b.s')}, {keep('b.z', 's')})",
        "u": "least(" + ", ".join([delete("b.u"), *[f(f"b.{x}", w) for x in "zsa" for f, w in ((rerole, "user"), (keep, "u"))]]) + ")",
        "a": f"least({delete('b.a')}, {rerole('b.u', 'assistant')}, {keep('b.u', 'a')})",
    }
    inserted = lambda source: f"select conv_id, i, z, s, u, least(a, {insert('u', 'assistant')}) as a from (select conv_id, i, z, s, least(u, {insert('z', 'user')}, {insert('s', 'user')}, {insert('a', 'user')}) as u, a from ({source}))"
    none = item(far, "''", "''")
    begin = f"select distinct conv_id, 0::bigint as i, {item(0, repr(''), repr(''))} as z, {none} as s, {none} as u, {none} as a from conversations"
    go = "select r.conv_id, r.i, " + ", ".join(f"{v} as {k}" for k, v in row.items()) + " from best b join f r on r.conv_id is not distinct from b.conv_id and r.i = b.i + 1"
    white = "\\x20\\x09-\\x0D"
    return f"""
with recursive g as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as fate from conversations
), d as (
    select conv_id, turn, case when fate = 4 then 'user' else role end as role, case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when fate = 3 then 2 else 1 end)) from g where fate <> 0
), o as (
    select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, sha256(length(role) || ':' || role || text)) as i,
      regexp_extract(text, '([^{white}])[{white}]*$', 1) as bare from d
), e as (
    select *, bare = '' as blank, bare <> '' and row_number() over (partition by conv_id, role, text order by i) > 1 as again, lag(role) over (partition by conv_id order by i) as before from o
), f as (select *, blank or again as gone, not blank and not again and bare not in ('.', '!', '?') as cut from e
), best as ({inserted(begin)} union all {inserted(go)}
), last as (select conv_id, least(z, a) as x from best qualify row_number() over (partition by conv_id order by i desc) = 1
), n as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again) as duplicate, count(*) filter (where cut) as truncated,
      count(*) filter (where before is not null and before[1:1] || role[1:1] not in ('su', 'ua', 'au')) as illegal from f group by 1
)
select l.conv_id, coalesce(n.gaps, 0)::bigint as gaps, coalesce(n.blank, 0)::bigint as blank, coalesce(n.duplicate, 0)::bigint as duplicate, coalesce(n.truncated, 0)::bigint as truncated, coalesce(n.illegal, 0)::bigint as illegal,
  l.x.c as cost, l.x.a as audit, sha256(substr(l.x.o, 2)) as repaired_sha256
from last l left join n on l.conv_id is not distinct from n.conv_id
"""


OP13_SQL = _repair()
