"""SQL equivalents of the llm queries, for DuckDB."""

_TEXT = r"coalesce(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'), '')"
_ENC = r"(?i)%(?:[01][0-9a-f]|2[0-9a-f]|3[a-f]|40|5[b-f]|60|7[b-f]|c2%(?:a[0-9a-f]|b[0-9a-f])|e2%80%[89ab][0-9a-f]|e2%81%a0|e3%80%[89][0-9a-f]|ef%bb%bf)"


def _plain(c: str) -> str:
    return _TEXT.format(c=f"regexp_replace({c}, '{_ENC}', '', 'g')")


_RECORDS = rf"""
with u as (select link_id, title, snippet, coalesce(url, '') as whole, split_part(coalesce(url, ''), '#', 1) as head from links),
v as (select *, split_part(head, '?', 1) as base, substr(whole, length(head) + 2) as frag from u),
k as (select link_id, concat_ws(chr(1), {_TEXT.format(c="snippet")}, {_TEXT.format(c="title")},
   concat({_plain("base")}, '?',
     array_to_string(list_sort(list_filter(list_transform(string_split_regex(substr(head, length(base) + 2), '[&;]'), lambda p: {_plain("p")}), lambda p: p <> '')), '&'),
     '#', {_plain("frag")})) as k from v),
g as (select k, min(link_id) as keep_link_id, count(*) as n_copies from k group by k)
"""

_REAL = r"""coalesce(regexp_matches(lower({c}), '[\p{{L}}\p{{N}}]') and regexp_replace(lower({c}), '^[\s\p{{Z}}\p{{C}}]+|[\s\p{{Z}}\p{{C}}]+$', '', 'g') not in
 ('null','none','nan','nil','n/a','n.a.','na','unknown','untitled','undefined','not available','(not available)','tbd','tba','[deleted]','[removed]','deleted','removed','missing','empty','no title','unspecified','not set'), false)"""
_BACKEND = r"nullif(regexp_replace(regexp_replace(lower({c}), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[\s\-]+', '_', 'g'), '')"

ORACLES = {
    "p4_found": _RECORDS + "select keep_link_id, link_id as copy_link_id from k join g using (k) where link_id <> keep_link_id",
    "p4_records": _RECORDS + "select keep_link_id, n_copies from g",
    "p4_summary": _RECORDS + "select sum(n_copies)::bigint as n_rows, count(*) as n_records, (sum(n_copies) - count(*))::bigint as n_copies, count(*) - count(distinct md5(k)) as n_collisions from g",
    "p6_found": f"""
with t as (select {_BACKEND.format(c="backend")} as b, min(trust_rank) as r from backend_trust group by 1),
m as (select distinct cluster_key, unnest(members) as link_id from link_clusters where len(list_distinct(members)) >= 2),
x as (select cluster_key, l.link_id, coalesce(r, 2147483647) as r, observed_at, {_REAL.format(c="title")} as title, {_REAL.format(c="snippet")} as snippet,
   {_REAL.format(c="creator")} as creator, coalesce(view_count >= 0, false) as view_count
   from m join links l using (link_id) left join t on t.b = {_BACKEND.format(c="backend_used")}),
f as (select cluster_key, 'title' as field_name, link_id, r, observed_at from x where title union all
   select cluster_key, 'snippet', link_id, r, observed_at from x where snippet union all
   select cluster_key, 'creator', link_id, r, observed_at from x where creator union all
   select cluster_key, 'view_count', link_id, r, observed_at from x where view_count),
o as (select *, row_number() over (partition by cluster_key, field_name order by r, observed_at desc nulls last, link_id) as n from f)
select cluster_key, field_name, link_id from o where n = 1""",
}
