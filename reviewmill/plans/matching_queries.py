"""Registered queries: branch lookup, matching, repair and location suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.operators import branches as dim
from reviewmill.operators import matching
from reviewmill.plans.binding import branch_dim, canonical_reviews, planned_branches, raw_items, review_rows, table
from reviewmill.plans.cleaning_queries import ITEMS_SQL, LOCATIONS_SQL, landed_locations
from reviewmill.plans.oracle import match_norm, norm, with_branches, with_reviews
from reviewmill.plans.registry import query
from reviewmill.sources.landed import flatten_locations


@query(
    "branch_lookup",
    with_reviews(
        """select name, location, count(*) as n, sum(rating)::bigint as rating_sum
        from reviews join branch_dim b on b.id = branch_id group by all"""
    ),
)
def branch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review figures are summed per branch before the lookup, so the join carries one row per branch."""
    sums = review_rows(spark, sf_dir, "rating").groupBy("branchId").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating_sum")
    )
    found = dim.branch_lookup(sums, branch_dim(spark, sf_dir))
    return found.select(F.col("lookup_name").alias("name"), "location", "n", "rating_sum")


@query(
    "branch_candidates",
    f"""select distinct s_suppkey as branch_ord, {norm('unnest')} as candidate
    from (select s_suppkey, unnest([s_name, lower(s_name) || ' & sons', n_name || '-' || s_suppkey, '', n_name])
      from supplier join nation on s_nationkey = n_nationkey) t(s_suppkey, unnest)
    where trim(unnest) <> ''""",
)
def branch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as branches: aliases, name, short name and search text, normalised, without blanks."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    branches = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.col("s_suppkey").alias("branch_ord"),
        F.array("s_name", F.concat(F.lower("s_name"), F.lit(" & sons"))).alias("aliases"),
        F.concat_ws("-", "n_name", "s_suppkey").alias("name"),
        F.lit("").alias("shortName"),
        F.col("n_name").alias("searchQuery"),
    )
    return matching.branch_candidates(branches)


@query(
    "match_by_id",
    with_reviews("select item_ord, branch_ord::bigint as branch_ord, tier from matched where tier <= 2", ITEMS_SQL),
)
def match_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = raw_items(spark, sf_dir).select("item_ord", "placeId", "cid", F.lit(None).cast("string").alias("title"))
    matched = matching.match_branches(items, branch_dim(spark, sf_dir)).where("match_tier <= 2")
    return matched.select(
        "item_ord", F.col("branch_ord").cast("bigint").alias("branch_ord"), F.col("match_tier").cast("bigint").alias("tier")
    )


# Page titles as item titles: the first heading word decides, so exact, longer and shorter titles occur.
_PAGE_TITLE = "nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')"

_TITLE_MATCH_SQL = f"""
site_rows as (select distinct on (site) * from (
    select page_id, regexp_extract(url, '^https?://([^./]+)', 1) as site, {_PAGE_TITLE} as title from pages)
  order by site, page_id),
sites as (select page_id as branch_ord, title from site_rows where title is not null),
cands as (select branch_ord, {match_norm('title')} as cand from sites
  union select branch_ord, split_part({match_norm('title')}, ' ', 1) from sites),
asked as (select distinct {match_norm(_PAGE_TITLE)} as nt from pages where {match_norm(_PAGE_TITLE)} <> ''),
hits as (
  select nt, branch_ord, case when nt = cand then 1 else 2 end as tier
  from asked join cands on cand <> '' and (starts_with(nt, cand) or starts_with(cand, nt))
)"""


@query(
    "match_by_title",
    f"""with {_TITLE_MATCH_SQL}
    select nt as title, min((tier, branch_ord))[1]::bigint as tier, min((tier, branch_ord))[2]::bigint as branch_ord
    from hits group by nt""",
)
def match_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles matched to the sites that first used such a title; sites act as branches."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", "^https?://([^./]+)", 1).alias("site"),
        F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"),
    )
    first = pages.groupBy("site").agg(F.min("page_id").alias("page_id"))
    named = pages.join(first, ["site", "page_id"], "left_semi").where("title is not null")
    word = F.split(matching.normalize_match_text("title"), " ")[0]
    sites = named.select(
        F.col("page_id").alias("branch_ord"),
        F.array(word).alias("aliases"),
        F.col("title").alias("name"),
        F.lit(None).cast("string").alias("shortName"),
        F.lit(None).cast("string").alias("searchQuery"),
    )
    titles = pages.select(matching.normalize_match_text("title").alias("title")).where("title != ''").distinct()
    found = matching.title_branches(titles, sites, matching.normalize_match_text, use_blocks=False)
    return found.select(
        "title", F.col("title_tier").cast("bigint").alias("tier"), F.col("title_ord").cast("bigint").alias("branch_ord")
    )


@query(
    "match_blocklist",
    with_reviews(
        "select title, branch_ord::bigint as branch_ord, tier, count(*) as n from matched where tier > 2 or tier is null group by all", ITEMS_SQL
    ),
)
def match_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where items without a known identifier go, block-lists applied."""
    items = raw_items(spark, sf_dir).select("item_ord", "placeId", "cid", "title")
    matched = matching.match_branches(items, branch_dim(spark, sf_dir))
    left = matched.where("match_tier > 2 or match_tier is null")
    return left.groupBy(
        "title", F.col("branch_ord").cast("bigint").alias("branch_ord"), F.col("match_tier").cast("bigint").alias("tier")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "repair_assignments",
    with_reviews(
        f"""select review_key, branch_id, branch_name, rating, published_at, title from (
          select b.id || '::' || f.id as review_key, b.id as branch_id, b.name as branch_name, f.rating, f.published_at, f.title,
            row_number() over (partition by b.id || '::' || f.id order by epoch_us(f.ts), f.review_key desc, f.tie desc) as nth
          from fixed f join branch_dim b on b.branch_ord = f.branch_ord
        ) where nth = 1""",
        f"""cand2 as (
          select branch_ord, {match_norm('c')} as cand from (
            select branch_ord, unnest(list_concat(aliases, [name, short_name, search_query])) as c from branch_dim)
        ),
        title2 as (select distinct title, {match_norm('title')} as nt from reviews),
        best2 as (
          select title, min((tier, branch_ord)) as best from (
            select title, branch_ord, case when nt = cand then 3 else 4 end as tier
            from title2 join cand2 on starts_with(nt, cand) or starts_with(cand, nt)
          ) group by title
        ),
        fixed as (
          select r.*, coalesce(p.branch_ord, c.branch_ord, t.best[2]) as branch_ord
          from reviews r left join branch_dim p on p.place_id = r.place_id left join branch_dim c on c.cid = r.cid
            left join best2 t on t.title = r.title
        )""",
    ),
)
def repair_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = canonical_reviews(spark, sf_dir).select(
        "id", "branchId", "branchName", "reviewKey", "rating", "publishedAt", "placeId", "cid", "title", "ord"
    )
    fixed = matching.repair_assignments(reviews, branch_dim(spark, sf_dir))
    return fixed.select(
        F.col("reviewKey").alias("review_key"), F.col("branchId").alias("branch_id"), F.col("branchName").alias("branch_name"),
        F.col("rating").cast("bigint").alias("rating"), F.col("publishedAt").alias("published_at"), "title",
    )


_UNIQUE_SQL = f"""
bc as (
  select branch_ord, blocked, unnest(list_concat(aliases, [name, short_name, search_query])) as raw from branch_dim
),
pairs as (
  select branch_ord, loc, max(nt = cand) as is_exact
  from (select branch_ord, blocked, {norm('raw')} as cand from bc) c
    join (select loc, {norm('title')} as nt from locations) l on nt <> '' and (starts_with(nt, cand) or starts_with(cand, nt))
  where not coalesce(list_contains(list_transform(blocked, lambda x: lower(x)), nt), false)
  group by branch_ord, loc
),
uniq as (
  select branch_ord, case when count(*) filter (where is_exact) = 1 then max(loc) filter (where is_exact)
    when count(*) filter (where is_exact) = 0 and count(*) = 1 then max(loc) end as loc
  from pairs group by branch_ord
)"""


@query(
    "unique_location_match",
    with_branches("select b.id as branch_id, u.loc from branch_dim b left join uniq u using (branch_ord)", LOCATIONS_SQL, _UNIQUE_SQL),
)
def unique_location_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    locations = landed_locations(spark, sf_dir).select("loc_ord", "title")
    branches = branch_dim(spark, sf_dir)
    found = matching.unique_location_match(branches, locations)
    return branches.select("branch_ord", F.col("id").alias("branch_id")).join(found, "branch_ord").select(
        "branch_id", F.col("loc_ord").alias("loc")
    )


@query(
    "location_suggestions",
    with_branches(
        f"""select b.id as branch_id, b.name as branch_name, nullif(b.location_name, '') as configured,
          l.title, l.full_name as suggested, l.place as place_id
        from branch_dim b left join uniq u using (branch_ord)
          left join locations c on c.full_name = b.location_name and not coalesce(
            list_contains(list_transform(b.blocked, lambda x: lower(x)), {norm('c.title')}), false)
          left join locations l on l.loc = coalesce(c.loc, u.loc)""",
        LOCATIONS_SQL,
        _UNIQUE_SQL,
    ),
)
def location_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = landed_locations(spark, sf_dir)
    # The flat form loses the row number, so it is joined back by the full name, unique per location.
    flat = flatten_locations(landed).withColumn(
        "loc_ord", F.regexp_extract("googleLocationName", r"(\d+)$", 1).cast("bigint")
    )
    found = matching.location_suggestions(branch_dim(spark, sf_dir), flat)
    return found.select(
        F.col("branchId").alias("branch_id"), F.col("branchName").alias("branch_name"),
        F.col("configuredGoogleLocationName").alias("configured"), F.col("suggestedTitle").alias("title"),
        F.col("suggestedGoogleLocationName").alias("suggested"), F.col("suggestedPlaceId").alias("place_id"),
    )


@query(
    "active_branches",
    with_reviews(
        """select id as branch_id from (select id, branch_ord from branch_dim union all select 'planned-' || id, branch_ord from branch_dim)
        where branch_ord % 4 = 0 or id in (select branch_id from reviews where source = 'Manual update')"""
    ),
)
def active_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth branch is stored; others become active through an addition, planned ones don't."""
    branches = planned_branches(spark, sf_dir)
    additions = review_rows(spark, sf_dir, "reviewSource").where("reviewSource = 'Manual update'")
    active = dim.active_branches(branches, branches.where("branch_ord % 4 = 0"), additions)
    return active.select(F.col("id").alias("branch_id"))
