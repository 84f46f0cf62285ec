"""SQL views of the binding for the DuckDB side of the correctness check, written independently."""

BRANCHES = """
branch_dim as (
  select n_nationkey as branch_ord, 'n' || n_nationkey as id, n_name as name,
    'Branch ' || n_nationkey as short_name, r_name as location,
    case when n_nationkey % 4 <> 0 then 'accounts/a1/locations/' || n_nationkey else '' end as location_name,
    case when n_nationkey % 5 <> 0 then 'C' || n_nationkey end as cid,
    case when n_nationkey % 3 <> 0 then 'P' || n_nationkey end as place_id,
    'https://profile.example/' || n_nationkey as profile_url,
    n_name || ' ' || r_name as search_query,
    case when n_nationkey % 2 = 0 then 'https://maps.example/' || n_nationkey else '' end as maps_url,
    [n_name, lower(n_name) || ' branch'] as aliases,
    case when n_nationkey % 5 = 1 then [n_name, n_name || '0'] end as blocked,
    case when n_nationkey % 7 = 0 then 'F' || n_nationkey end as fid
  from nation join region on n_regionkey = r_regionkey
)"""

REVIEWS = """
base_rows as (
  select *, o_orderdate + to_minutes(cast(l_partkey % 1440 as int)) as ts
  from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey
    join part on l_partkey = p_partkey
),
title_rows as (
  select *, case l_partkey % 5
      when 0 then 'Nation_' || s_nationkey
      when 1 then 'NATION_' || s_nationkey || '  Branch - east'
      when 2 then 'branch ' || s_nationkey
      when 3 then 'nat'
      else 'Elsewhere & Co' end as title
  from base_rows
),
reviews as (
  select 'n' || s_nationkey as branch_id, l_orderkey || '-' || l_linenumber as id,
    'n' || s_nationkey || '::' || l_orderkey || '-' || l_linenumber as review_key,
    'NATION_' || s_nationkey as branch_name,
    'Customer ' || o_custkey as reviewer,
    cast((l_orderkey + 3 * l_linenumber + l_partkey) % 6 as bigint) as rating,
    case when cast(l_quantity as int) % 3 = 0 then '' else p_name end as comment,
    case when cast(l_quantity as int) % 6 = 0 then ' translated ' else '' end as translated,
    ts, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as published_at,
    case when l_partkey % 5 <> 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as updated_at,
    case l_returnflag when 'R' then 'Google' when 'A' then 'Manual update'
      else 'Google Business Profile review' end as source,
    case when l_linestatus = 'F' then 'Thank you' else '' end as response,
    case when l_linestatus = 'F' and l_partkey % 3 = 0 then '2001-06-01T00:00:00Z' end as response_date,
    l_partkey % 4 = 0 as local_guide,
    case when l_partkey % 3 = 0 then 'P' || s_nationkey end as place_id,
    case when l_partkey % 3 = 1 then 'C' || s_nationkey end as cid,
    title,
    concat_ws('|', lpad(l_partkey::varchar, 12, '0'), lpad(l_suppkey::varchar, 12, '0'),
      lpad(cast(l_quantity as int)::varchar, 6, '0'),
      lpad(cast(round(l_extendedprice * 100) as bigint)::varchar, 14, '0'), l_returnflag, l_linestatus) as tie
  from title_rows
)"""

AS_OF = "timestamp '2001-07-01 12:00:00'"


def norm(text: str) -> str:
    """Normalised text; the tables hold plain spaces, line breaks and tabs only."""
    return (
        f"trim(regexp_replace(replace(replace(lower(coalesce({text}, '')), '&', 'and'), '-', ' '), "
        rf"'[\s\x{{00A0}}]+', ' ', 'g'))"
    )


def match_norm(text: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({text}, '')), '&', 'and'), '[^a-z0-9]+', ' ', 'g'))"


def round1(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5) / 10.0)"


def pct(part: str, total: str) -> str:
    return f"(case when ({total}) <> 0 then cast({part} as double) / ({total}) else 0.0 end * 100)"


def avg_pos(x: str = "rating", where: str = "true") -> str:
    return f"coalesce(avg({x}) filter (where {x} > 0 and {where}), 0.0)"


def with_reviews(body: str, *more: str) -> str:
    return "with " + ",\n".join([BRANCHES, REVIEWS, *more]) + "\n" + body


def with_branches(body: str, *more: str) -> str:
    return "with " + ",\n".join([BRANCHES, *more]) + "\n" + body
