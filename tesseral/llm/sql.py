"""DuckDB SQL of the longer corpus queries."""

from __future__ import annotations

#: More levels than any table that DuckDB holds needs: 3 ** 20 leaves.
_LEVELS = 20


def _tree(name: str, keys: str, levels: int) -> str:
    """CTEs of a tree's levels over {name}_0 (keys, idx, n, digest); {name}_up_i and {name}_i; a key with one node stays as it is."""
    out = []
    for i in range(levels):
        out.append(
            f"{name}_{i + 1} as materialized (select {keys}, idx // 3 as idx, (any_value(n) + 2) // 3 as n, "
            f"case when any_value(n) = 1 then any_value(digest) else sha256(string_agg(digest, '' order by idx)) end as digest "
            f"from {name}_{i} group by {keys}, idx // 3)"
        )
    return ",\n".join(out)


def _way(name: str, keys: tuple[str, ...], start: str, columns: str, levels: int) -> str:
    """CTEs that follow rows (columns, keys, idx, proof, folded) of `start` up the levels of a tree; {name}_way_{levels} ends it."""
    out, same = [], " and ".join(f"m.{k} = w.{k}" for k in keys)
    for i in range(levels):
        source = start if i == 0 else f"{name}_way_{i}"
        out.append(
            f"{name}_way_{i + 1} as materialized (select {columns}, {', '.join('w.' + k for k in keys)}, w.idx // 3 as idx, "
            f"w.proof || s.l || s.r as proof, case when s.n = 1 then w.folded else sha256(s.l || w.folded || s.r) end as folded "
            f"from {source} w join (select m.*, coalesce(string_agg(digest, '') over (run rows between unbounded preceding and 1 preceding), '') as l, "
            f"coalesce(string_agg(digest, '') over (run rows between 1 following and unbounded following), '') as r "
            f"from {name}_{i} m window run as (partition by {', '.join(keys)}, idx // 3 order by idx)) s on {same.replace('m.', 's.')} and s.idx = w.idx)"
        )
    return ",\n".join(out)


def _field(column: str) -> str:
    return f"case when {column} is null then '-' else strlen({column}::varchar)::varchar || ':' || {column}::varchar end"


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_CHANGED = _FIELDS.replace("text", "replace(text, chr(10), '')")

OP13 = f"""
with crc_table as (
  select list(v order by i) as crcs from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from (select unnest(range(256)) as i))
), hashed as (
  select row_number() over () as row_id, doc_id, case when source is null then '' else '=' || source end as key, sha256({_FIELDS}) as digest,
    case when xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0
    then sha256({_CHANGED}) else sha256({_FIELDS}) end as tested
  from documents, crc_table
), leaves as materialized (
  select *, row_number() over (partition by key order by doc_id nulls first, digest) - 1 as idx, count(*) over (partition by key) as n from hashed
), tree_0 as (select key, idx, n, digest from leaves),
{_tree("tree", "key", _LEVELS)},
top_0 as (select 0 as one, key, row_number() over (order by key) - 1 as idx, count(*) over () as n, digest from tree_{_LEVELS}),
{_tree("top", "one", _LEVELS)},
leaf_start as (select doc_id, digest as leaf, key, idx, '' as proof, coalesce(tested, digest) as folded from leaves),
{_way("tree", ("key",), "leaf_start", "w.doc_id, w.leaf", _LEVELS)},
top_start as (
  select w.doc_id, w.leaf, t.digest as subroot, 0 as one, t.idx, w.proof, w.folded from tree_way_{_LEVELS} w join top_0 t on t.key = w.key
),
{_way("top", ("one",), "top_start", "w.doc_id, w.leaf, w.subroot", _LEVELS)}
select w.doc_id, w.leaf, w.subroot, r.digest as root, sha256(w.proof) as proof_sha256, w.folded as folded_root, w.folded = r.digest as verified
from top_way_{_LEVELS} w, top_{_LEVELS} r
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = f"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') as terms
  from documents
), seen as materialized (
  select lang, source, d, term, count(*) as n from (select lang, source, d, unnest(terms) as term from docs) group by all
), kept as materialized (
  select lang, term, sum(n) as n from seen group by all having count(distinct d) >= 30
), groups as (
  select distinct lang, source from docs
), langs as (
  select g.lang, coalesce(sum(k.n), 0) as total, count(k.term) as v from (select distinct lang from groups) g left join kept k using (lang) group by g.lang
), totals as (
  select g.lang, g.source, coalesce(sum(s.n), 0) as total from groups g
  left join (select s.* from seen s join kept k using (lang, term)) s using (lang, source) group by all
), counts as (
  select lang, source, term, sum(n) as n from seen group by all
), probs as materialized (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)::hugeint) // (t.total + 5 * l.v)::hugeint as p,
    1 + (1000000000::hugeint * (k.n + 5)::hugeint) // (l.total + 5 * l.v)::hugeint as q
  from totals t join langs l using (lang) join kept k using (lang) left join counts c using (lang, source, term)
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select a.lang, a.source, b.source as other, sum(abs(a.p - b.p)) as value
    from probs a join probs b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  ) s on s.lang = a.lang and s.source = a.source and s.other = b.source
), terms as (
  select lang, source, 'term' as part, term as item, p - q as value from probs where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms)
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""
