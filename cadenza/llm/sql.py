"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, secret_scan


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _secret_matches(kind: str, pattern: str) -> str:
    value = f"regexp_extract(string_split(p, chr(2))[1], {_quoted(pattern)}, 1)" if kind == "assign" else "string_split(p, chr(2))[1]"
    return f"""
  select rid, doc_id, owner, repository, '{kind}' as kind, n_start as start, n_start + size as "end", value from (
    select *, sum(gap + size) over (partition by rid order by i) - size as n_start from (
      select rid, doc_id, owner, repository, i, {value} as value,
        length(string_split(p, chr(2))[1]) as size,
        case when i = 2 then length(parts[1]) else length(parts[i - 1]) - length(string_split(parts[i - 1], chr(2))[1]) - 1 end as gap
      from (select rid, doc_id, owner, repository, parts, unnest(range(2, len(parts) + 1)) as i, unnest(parts[2:]) as p
        from (select *, string_split(regexp_replace(clean, {_quoted(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) as parts from cleaned))))"""


_PATTERNS = {"assign": secret_scan.either_case(secret_scan.ASSIGN), "access": secret_scan.ACCESS, "hex": secret_scan.HEX}

SECRETS_SQL = f"""
with cleaned as (
  select row_number() over () as rid, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as clean,
    source as owner, lang as repository from documents),
found as ({" union all ".join(_secret_matches(k, p) for k, p in _PATTERNS.items())}),
spans as (select *, sha256(value) as hash from found where kind <> 'assign' or length(value) >= {secret_scan.LEAST_ASSIGN}),
ownership as (select hash, count(distinct coalesce(owner, '')) >= {secret_scan.COPIED_FROM} or count(distinct (coalesce(owner, ''), coalesce(repository, ''))) >= {secret_scan.COPIED_REPOSITORIES} as copied,
  bool_or(kind <> 'hex') as named from spans group by hash),
judged as (select s.*, copied, named and not copied and not regexp_matches(lower(value), {_quoted(secret_scan.PLACEHOLDER)}) as live
  from spans s join ownership o on s.hash = o.hash),
listed as (
  select rid, start, list_position(['assign', 'access', 'hex'], kind) as k, "end", kind || ':' || start || ':' || "end" as said from judged
  union all select rid, start, 4, "end", 'live:' || start || ':' || "end" from judged where live),
per as (
  select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    count(*) filter (live) as n_live, count(*) filter (copied) as n_copied from judged group by rid),
texts as (
  select rid, string_agg(said, ',' order by start, k, "end") filter (k < 4) as base, string_agg(said, ',' order by start, k, "end") as spans from listed group by rid)
select c.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from cleaned c left join per using (rid) left join texts using (rid)"""


def _license_ids(ends: str) -> str:
    normal = f"regexp_replace(regexp_replace(s, {_quoted(licenses.OTHER)}, ' ', 'g'), {_quoted(licenses.OUTER)}, '', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array(low, {_quoted(ends)}), lambda s: known[{normal}]), lambda x: x is not null)"


_KNOWN = "map {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in (licenses.SENTENCES | licenses.WHOLE_SENTENCES).items()) + "}"
_RULES = "[" + ", ".join(f"{{'sequence': {_quoted(',' + ','.join(seq) + ',')}, 'license': {_quoted(name)}}}" for seq, name in licenses.RULES + licenses.WHOLE_RULES) + "]"
_COVERS = "[" + ", ".join(f"{{'more': {_quoted(name)}, 'less': [{', '.join(map(_quoted, less))}]}}" for name, less in licenses.COVERS.items()) + "]"

#: No text is left out beforehand here: every one is split into sentences.
LICENSES_SQL = f"""
with d as (select doc_id, regexp_replace(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), {_quoted(licenses.TAG)}, chr(10) || 'spdx-license-identifier ', 'g') as low, {_KNOWN} as known from documents),
r as (select doc_id, {_license_ids(licenses.ENDS)} as wrapped, {_license_ids(licenses.LINE_ENDS)} as lines from d),
f as (select doc_id, case when len(wrapped) >= len(lines) then wrapped else lines end as ids from r),
h as (select doc_id, ids, list_transform(list_filter({_RULES}, lambda r: contains(',' || array_to_string(ids, ',') || ',', r.sequence)), lambda r: r.license) as all_held from f),
u as (select doc_id, ids, list_filter(all_held, lambda x, i: list_position(all_held, x) = i) as held from h)
select doc_id, len(ids) as n_sentences, array_to_string(ids, ',') as sentence_ids, array_to_string(list_filter(held, lambda x: not list_contains(flatten(list_transform({_COVERS}, lambda c: case when list_contains(held, c.more) then c.less else [] end)), x)), ',') as licenses from u"""
