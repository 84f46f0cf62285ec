"""Registered queries: sources, parsing and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.functions import numbers, text
from reviewmill.functions.dates import normalize_date
from reviewmill.operators import branches as dim
from reviewmill.operators import normalize as normalizers
from reviewmill.operators.normalize import normalize_paged
from reviewmill.plans.binding import (
    FETCHED_AT,
    branch_dim,
    canonical_reviews,
    item_names,
    raw_items,
    review_pages,
    review_rows,
    table,
)
from reviewmill.plans.jobs import matched_items
from reviewmill.plans.oracle import match_norm, norm, with_branches, with_reviews
from reviewmill.plans.registry import query
from reviewmill.schemas import ADDITIONS, BRANCH_CONFIG, LOCATION, REMOVALS, REVIEW_FIELDS
from reviewmill.session import scratch_path
from reviewmill.sources import csv_inputs, documents, landed

#: Rows of a compressed file of JSON lines.
SHARD_ROWS = 250_000

# --- text and number parsing ------------------------------------------------------------------------------


@query("normalize_text", f"select doc_id, {norm('text')} as normalized from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text("text").alias("normalized"))


@query("normalize_match_text", f"select doc_id, {match_norm('text')} as normalized from documents")
def normalize_match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_match_text("text").alias("normalized"))


@query(
    "rating_parse",
    """select l_linenumber::bigint as line,
      case when l_partkey % 9 between 1 and 5 and l_partkey % 4 <> 3 then l_partkey % 9 end::bigint as rating, count(*) as n
    from lineitem group by all""",
)
def rating_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings typed by hand: padded, out of range, with decimals."""
    k = F.col("l_partkey")
    number = (k % 9).cast("string")
    typed = F.when(k % 4 == 3, F.concat(number, F.lit(".5"))).when(k % 4 == 2, F.concat(F.lit(" \t"), number, F.lit(" "))).otherwise(number)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("line"), numbers.parse_rating(typed).cast("bigint").alias("rating")
    )
    return rows.groupBy("line", "rating").agg(F.count(F.lit(1)).alias("n"))


@query(
    "star_enum",
    """select l_linenumber::bigint as line,
      case l_partkey % 8 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 4 when 5 then 5 else 0 end::bigint as from_word,
      case when l_partkey % 8 between 1 and 5 then l_partkey % 8 else 0 end::bigint as from_number, count(*) as n
    from lineitem group by all""",
)
def star_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating words in mixed case and with spaces; digits as text are not words."""
    k = F.col("l_partkey") % 8
    words = F.array(*[F.lit(w) for w in ("zero", "ONE", " two ", "Three", "fOUR", "FIVE\n", "5", "")])
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("line"),
        numbers.star_word(F.element_at(words, (k + 1).cast("int"))).cast("bigint").alias("from_word"),
        numbers.star_number(k).cast("bigint").alias("from_number"),
    )
    return rows.groupBy("line", "from_word", "from_number").agg(F.count(F.lit(1)).alias("n"))


_TYPED_TS = "o_orderdate + to_minutes(cast(o_custkey % 1440 as int))"


@query(
    "parse_dates",
    f"""with typed as (select o_orderkey, o_orderkey % 11 as k, {_TYPED_TS} as ts from orders)
    select o_orderkey, strftime(case
      when k in (0, 1) then date_trunc('day', ts) + interval 12 hour
      when k in (2, 3, 4, 7) then ts
      when k in (5, 8) then ts - interval 2 hour
      when k = 6 then date_trunc('day', ts) + case when day(ts) < 10 then interval 12 hour else interval 0 hour end
      end, '%Y-%m-%dT%H:%M:%SZ') as parsed from typed""",
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates typed in every accepted layout, and two unreadable ones."""
    k = F.col("o_orderkey") % 11
    ts = (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_custkey") % 1440).cast("int"))).cast("timestamp")
    typed = F.when(k == 0, F.date_format(ts, " yyyy-MM-dd "))
    layouts = {
        1: "dd/MM/yyyy", 2: "d/M/yyyy HH:mm", 3: "yyyy-MM-dd HH:mm", 4: "yyyy-MM-dd'T'HH:mm:ss'Z'",
        5: "yyyy-MM-dd'T'HH:mm:ss'+02:00'", 6: "d MMM yyyy", 7: "dd MMM yyyy H:mm", 8: "yyyy-MM-dd'T'HH:mm:ss'+0200'",
        9: "'soon'", 10: "yyyy.MM.dd",
    }
    for n, layout in layouts.items():
        typed = typed.when(k == n, F.date_format(ts, layout))
    return table(spark, sf_dir, "orders").select("o_orderkey", normalize_date(typed).alias("parsed"))


@query(
    "optional_casts",
    """select o_orderkey,
      case when o_orderkey % 4 = 0 then o_custkey when o_orderkey % 4 = 1 then -o_custkey else 0 end::bigint as whole,
      o_orderkey % 6 < 4 as truth from orders""",
)
def optional_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = F.col("o_custkey").cast("string")
    typed = (
        F.when(k % 4 == 0, F.concat(F.lit(" "), number)).when(k % 4 == 1, F.concat(F.lit("-"), number)).when(k % 4 == 2, "many").otherwise("")
    )
    words = F.array(*[F.lit(w) for w in ("1", "TRUE", " yes", "Y", "no", "")])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        numbers.optional_int(typed).alias("whole"),
        numbers.optional_bool(F.element_at(words, (k % 6 + 1).cast("int"))).alias("truth"),
    )


@query(
    "synthetic_id",
    """select doc_id, 'manual-' || left(sha1(concat_ws('|', source, lang, n_chars % 5, '2026-01-01T12:00:00Z',
      regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), 16) as id from documents""",
)
def synthetic_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = text.synthetic_id(
        text.MANUAL_ID_PREFIX, "source", "lang", F.col("n_chars") % 5, F.lit("2026-01-01T12:00:00Z"), "text"
    )
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("id"))


# --- sources --------------------------------------------------------------------------------------------


@query(
    "scan_dataset_doc",
    with_reviews(
        """select b.branch_ord::bigint as branch_ord, b.id as branch_id, b.name, count(r.branch_id) as n, sum(rating)::bigint as rating_sum,
        max(published_at) as newest, count(*) filter (where response <> '') as answered
        from branch_dim b left join reviews r on r.branch_id = b.id group by all"""
    ),
)
def scan_dataset_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews written as document shards of one review each, the branches as one document, read back."""
    path = scratch_path(spark, "dataset-doc")
    reviews = canonical_reviews(spark, sf_dir).select(F.array(F.struct(*REVIEW_FIELDS)).alias("reviews"))
    shards = reviews.select(F.to_json(F.struct("reviews")).alias("value"))
    listed = branch_dim(spark, sf_dir).agg(
        F.array_sort(F.collect_list(F.struct("branch_ord", *BRANCH_CONFIG.fieldNames()))).alias("branches")
    )
    head = listed.select(F.to_json(F.struct("branches")).alias("value"))
    # Compressed shards can't be split, so a file holds a bounded number of them.
    shards.unionByName(head).write.option("maxRecordsPerFile", SHARD_ROWS).text(path, compression="gzip")
    docs = documents.read_documents(spark, path, shards=True)
    held = documents.document_reviews(docs).groupBy("branchId").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rating").alias("rating_sum"),
        F.max("publishedAt").alias("newest"),
        F.count_if(F.col("ownerResponseText") != "").alias("answered"),
    )
    branches = documents.document_branches(docs)
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "answered")]
    return branches.join(held, branches["id"] == held["branchId"], "left").select(
        F.col("branch_ord").cast("bigint").alias("branch_ord"), F.col("id").alias("branch_id"), "name", "rating_sum", "newest", *none
    )


def _typed_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as hand-typed additions with every kind of mistake."""
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    k = F.col("l_partkey")
    same = k % 40 == 3
    branch = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    ship = F.col("l_shipdate").cast("timestamp")
    unique = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    return rows.select(
        F.when(~same & (k % 50 == 0), "zz").when(k % 3 == 0, F.concat(F.lit(" "), branch, F.lit(" "))).otherwise(branch).alias("branch_id"),
        F.when(same, "Same").when(k % 7 != 0, F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))).otherwise(" ").alias("reviewer_name"),
        F.when(same, "5").when(k % 11 == 0, "6").when(k % 11 == 1, "four").otherwise((k % 5 + 1).cast("string")).alias("rating"),
        F.when(same, "2026-01-01").when(k % 13 == 0, "").when(k % 13 == 1, "soon")
        .when(k % 13 == 2, F.date_format(ship, "d/M/yyyy")).when(k % 13 == 3, F.date_format(ship, "dd MMM yyyy HH:mm"))
        .otherwise(F.date_format(ship, "yyyy-MM-dd")).alias("published_at"),
        F.when(same, "same").when(k % 4 == 0, F.concat(F.lit('Row "x",\n'), unique)).when(k % 6 == 0, 'He said "good",\nindeed').when(k % 6 == 1, "  plain  ").otherwise("").alias("comment"),
        F.when(k % 2 == 0, "Thank you").otherwise("").alias("owner_response_text"),
        F.when(~same & (k % 2 == 0), F.when(k % 26 == 6, "later").otherwise("2026-02-01 10:00")).otherwise("").alias("owner_response_date"),
        F.lit("").alias("review_url"),
        F.when(same, "same").when(k % 4 == 0, "").otherwise(unique).alias("review_id"),
        F.when(k % 2 == 0, "Yes").otherwise("").alias("is_local_guide"),
        F.when(~same & (k % 3 == 0), "7").otherwise("x").alias("reviewer_review_count"),
        F.lit("").alias("reviewer_url"),
        F.when(~same & (k % 5 == 0), "de").otherwise("").alias("language"),
    )


_ADDITIONS_SQL = with_branches(
    """select branch_id, error, count(*) as n, sum(rating)::bigint as rating_sum, sum(length(comment))::bigint as comment_chars,
      max(published_at) as newest, count(*) filter (where reviewer = 'Anonymous reviewer') as anonymous,
      sum(reviews_written)::bigint as reviews_written, count(*) filter (where local_guide) as guides,
      count(*) filter (where language = 'de') as german, count(*) filter (where id like 'manual-%') as made_ids,
      min(case when error = 'ok' then id end) as first_id
    from (
      select *, case when numbered.error = 'ok' and nth > 1 then 'duplicate review_id' else numbered.error end as error
        from numbered
    ) group by branch_id, error""",
    """typed as (
      select *, l_partkey as k, l_partkey % 40 = 3 as same,
        case when l_partkey % 40 <> 3 and l_partkey % 50 = 0 then 'zz' else 'n' || s_nationkey end as branch_id
      from lineitem join supplier on l_suppkey = s_suppkey
    ),
    fields as (
      select *, case when same then 'Same' when k % 7 <> 0 then 'Supplier ' || l_suppkey else 'Anonymous reviewer' end as reviewer,
        case when same then 5 when k % 11 in (0, 1) then null else k % 5 + 1 end as rating,
        case when same then '2026-01-01T12:00:00Z' when k % 13 in (0, 1) then null
          when k % 13 = 3 then strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ')
          else strftime(l_shipdate, '%Y-%m-%dT12:00:00Z') end as published_at,
        case when same then 'same' when k % 4 = 0 then 'Row "x",' || chr(10)
          || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) when k % 6 = 0 then 'He said "good",' || chr(10) || 'indeed' when k % 6 = 1 then 'plain' else '' end as comment,
        case when not same and k % 3 = 0 then 7 else 0 end as reviews_written, k % 2 = 0 as local_guide,
        case when not same and k % 5 = 0 then 'de' else 'en' end as language
      from typed
    ),
    checked as (
      select *, case when same then 'same'
          when k % 4 = 0 then 'manual-' || left(sha1(concat_ws('|', branch_id, reviewer, rating, published_at, comment)), 16)
          else concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) end as id,
        case when branch_id = 'zz' then 'unknown branch_id'
          when not same and k % 11 = 1 then 'rating must be a whole number from 1 to 5'
          when not same and k % 11 = 0 then 'rating must be between 1 and 5'
          when not same and k % 13 = 0 then 'published_at is required'
          when not same and k % 13 = 1 then 'could not understand date'
          when not same and k % 26 = 6 then 'could not understand date' else 'ok' end as error
      from fields
    ),
    numbered as (select *, row_number() over (partition by branch_id, id) as nth from checked)""",
)


_ADDITIONS_SQL = _ADDITIONS_SQL.replace("select *, case when numbered.error", "select * exclude (error), case when numbered.error")
ADDITION_ERRORS_SQL = f"select error, sum(n)::bigint as n from ({_ADDITIONS_SQL}) where error <> 'ok' group by error"


@query("load_additions", _ADDITIONS_SQL)
def load_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions written as CSV with quoted line breaks, read back and loaded strictly."""
    path = scratch_path(spark, "additions")
    _typed_additions(spark, sf_dir).write.options(header=True, quote='"', escape='"').csv(path)
    rows = csv_inputs.load_additions(csv_inputs.read_csv(spark, path, ADDITIONS), branch_dim(spark, sf_dir), None, FETCHED_AT)
    error = F.coalesce("error", F.lit("ok"))
    return rows.groupBy(F.col("branchId").alias("branch_id"), error.alias("error")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rating").alias("rating_sum"),
        F.sum(F.length("comment")).cast("bigint").alias("comment_chars"),
        F.max("publishedAt").alias("newest"),
        F.count_if(F.col("reviewerName") == text.ANONYMOUS).alias("anonymous"),
        F.sum("reviewerReviewCount").alias("reviews_written"),
        F.count_if("isLocalGuide").alias("guides"),
        F.count_if(F.col("language") == "de").alias("german"),
        F.count_if(F.col("id").startswith(text.MANUAL_ID_PREFIX)).alias("made_ids"),
        F.min(F.when(F.col("error").isNull(), F.col("id"))).alias("first_id"),
    )


def _typed_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir, "id", "rating", "ownerResponseText").where("rating = 1")
    key = F.length("id")
    return rows.select(
        F.when(key % 4 == 0, F.concat(F.col("branchId"), F.lit("  "))).otherwise(F.col("branchId")).alias("branch_id"),
        F.when(F.col("id").endswith("-3"), " ").otherwise(F.col("id")).alias("review_id"),
        F.lit("somebody").alias("reviewer_name"),
        F.lit("2026-01-01").alias("published_at"),
        F.lit("gone, \"for good\"").alias("reason"),
    )


_REMOVED_SQL = "select branch_id, case when id like '%-3' then '' else id end as review_id from reviews where rating = 1"


@query(
    "load_removals",
    with_reviews(
        f"""select branch_id, case when review_id = '' then 'review_id is required' when nth > 1 then 'duplicate removal' else 'ok' end as error,
        count(*) as n from (select *, row_number() over (partition by branch_id, review_id) as nth from ({_REMOVED_SQL}))
        group by 1, 2"""
    ),
)
def load_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "removals")
    _typed_removals(spark, sf_dir).write.options(header=True, quote='"', escape='"').csv(path)
    rows = csv_inputs.load_removals(csv_inputs.read_csv(spark, path, REMOVALS), branch_dim(spark, sf_dir))
    return rows.groupBy(F.col("branchId").alias("branch_id"), F.coalesce("error", F.lit("ok")).alias("error")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "removal_keys",
    with_reviews(f"select distinct branch_id || '::' || review_id as review_key from ({_REMOVED_SQL}) where review_id <> ''"),
)
def removal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_inputs.removal_keys(_typed_removals(spark, sf_dir)).withColumnRenamed("reviewKey", "review_key")


# --- landed items ---------------------------------------------------------------------------------------

# Matching of the bound items, stated by hand: identifiers first, then what each title kind leads to.
ITEMS_SQL = """
items as (
  select *, l_partkey as k,
    case when l_partkey % 3 = 0 then 'P' || s_nationkey end as i_place,
    case when l_partkey % 3 = 1 then 'C' || s_nationkey end as i_cid,
    ((l_orderkey * 8 + l_linenumber) * 100000 + (l_partkey % 10000) * 10 + l_suppkey % 10)::bigint as item_ord
  from title_rows
),
candidates as (
  select branch_ord, blocked, unnest(list_transform(list_concat(aliases, [name, short_name, search_query]),
    lambda x: trim(regexp_replace(replace(replace(lower(x), '&', 'and'), '-', ' '), '\\s+', ' ', 'g')))) as cand from branch_dim
),
titles as (
  select distinct title, trim(regexp_replace(replace(replace(lower(title), '&', 'and'), '-', ' '), '\\s+', ' ', 'g')) as nt from items
),
by_title as (
  select title, min((tier, branch_ord)) as best from (
    select title, branch_ord, case when nt = cand then 3 else 4 end as tier
    from titles join candidates on starts_with(nt, cand) or starts_with(cand, nt)
    where not coalesce(list_contains(list_transform(blocked, lambda x: lower(x)), nt), false)
  ) group by title
),
matched as (
  select i.*, coalesce(p.branch_ord, c.branch_ord, t.best[2]) as branch_ord,
    case when p.branch_ord is not null then 1 when c.branch_ord is not null then 2 else t.best[1] end::bigint as tier
  from items i left join branch_dim p on p.place_id = i.i_place left join branch_dim c on c.cid = i.i_cid
    left join by_title t on t.title = i.title
)"""

_DATED = """
dated as (
  select m.*, b.id as branch_id, b.name as branch_name, b.place_id as b_place, b.cid as b_cid, b.fid as b_fid, b.maps_url, b.profile_url,
    (l_orderkey + 3 * l_linenumber + l_partkey) % 6 as rating,
    case when k % 8 = 0 then case when k % 16 <> 0 then '2001-07-01T12:00:00Z' end
      else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as published_at,
    case when o_custkey % 7 <> 0 then 'Customer ' || o_custkey else 'Anonymous reviewer' end as reviewer,
    case when cast(l_quantity as int) % 3 <> 0 then p_name else '' end as comment
  from matched m join branch_dim b on b.branch_ord = m.branch_ord
)"""


@query(
    "normalize_items",
    with_reviews(
        """select item_ord, branch_id,
          case when k % 10 = 0 then 'apify-' || left(sha1(concat_ws('|', branch_id, reviewer, rating, published_at, comment)), 16)
            else l_orderkey || '-' || l_linenumber end as id,
          branch_name, reviewer, case when k % 3 = 0 then 12 else 0 end::bigint as reviews_written,
          k % 4 = 0 as local_guide, rating::bigint as rating, comment,
          case when k % 9 = 0 then 'translated' else '' end as translated, published_at,
          case when k % 5 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') else published_at end as updated_at,
          case when l_returnflag = 'A' then 'Tripadvisor' else 'Google' end as source,
          case when l_linestatus = 'F' then 'Thank you' else '' end as response,
          case when l_linestatus = 'F' then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as response_date,
          case when k % 2 = 0 then 'de' else 'en' end as language,
          case when k % 3 = 0 then ' P' || s_nationkey else b_place end as place_id,
          case when k % 3 = 1 then 'C' || s_nationkey else b_cid end as cid, b_fid as fid,
          case when k % 6 = 0 then 'https://place.example/' || s_nationkey
            when maps_url <> '' then maps_url else profile_url end as place_url, title
        from dated where published_at is not null and rating <> 0""",
        ITEMS_SQL,
        _DATED,
    ),
)
def normalize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped items matched to branches and brought to the canonical record."""
    items, names = raw_items(spark, sf_dir), item_names(spark, sf_dir)
    reviews = normalizers.normalize_items(matched_items(items, branch_dim(spark, sf_dir), names), FETCHED_AT)
    return reviews.select(
        "item_ord", F.col("branchId").alias("branch_id"), "id", F.col("branchName").alias("branch_name"),
        F.col("reviewerName").alias("reviewer"), F.col("reviewerReviewCount").cast("bigint").alias("reviews_written"),
        F.col("isLocalGuide").alias("local_guide"), F.col("rating").cast("bigint").alias("rating"), "comment",
        F.col("commentTranslated").alias("translated"), F.col("publishedAt").alias("published_at"),
        F.col("updatedAt").alias("updated_at"), F.col("reviewSource").alias("source"),
        F.col("ownerResponseText").alias("response"), F.col("ownerResponseDate").alias("response_date"), "language",
        F.col("placeId").alias("place_id"), "cid", "fid", F.col("placeUrl").alias("place_url"), "title",
    )


@query(
    "branch_updates",
    with_reviews(
        """select branch_id, (s_nationkey || '0')::double as review_count, 4.46 as rating,
          case when k % 6 = 0 then 'https://place.example/' || s_nationkey end as place_url,
          case when k % 3 = 0 then ' P' || s_nationkey end as place_id
        from dated qualify row_number() over (partition by branch_id order by item_ord desc) = 1""",
        ITEMS_SQL,
        _DATED,
    ).replace("4.46 as rating", "4.46::double as rating"),
)
def branch_updates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, names = raw_items(spark, sf_dir), item_names(spark, sf_dir)
    updates = normalizers.branch_updates(matched_items(items, branch_dim(spark, sf_dir), names))
    return updates.select(
        F.col("branchId").alias("branch_id"),
        F.col("currentReviewsCount").alias("review_count"),
        F.col("currentRating").alias("rating"),
        F.col("placeUrl").alias("place_url"),
        F.col("placeId").alias("place_id"),
    )


# --- paged payloads ---------------------------------------------------------------------------------------

PAGES_SQL = """
page_rows as (
  select *, 'n' || c_nationkey as branch_id, l_partkey as k,
    ((l_orderkey * 8 + l_linenumber) * 100000 + (l_partkey % 10000) * 10 + l_suppkey % 10)::bigint as page_no,
    case l_partkey % 7 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 4 when 5 then 5 else 0 end as stars,
    strftime(o_orderdate, '%Y-%m-%dT08:00:00Z') as created
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
),
paged as (
  select page_no, branch_id, l_orderkey || '-' || l_linenumber as id, stars, created,
    case when k % 2 = 0 then '2001-07-01T12:00:00Z' else created end as updated,
    case when k % 11 <> 0 then 'Customer ' || o_custkey else 'Anonymous reviewer' end as reviewer,
    case when k % 3 <> 0 then 'part ' || k else '' end as comment,
    case when l_linestatus = 'F' then 'Thank you' else '' end as response
  from page_rows where k % 20 <> 0 and k % 30 <> 1 and stars > 0
)"""


@query(
    "explode_pages",
    with_branches(
        """select branch_id, count(*) as pages, arg_max(k % 50, page_no) filter (where k % 50 > 0) as total_reviews,
          round(arg_max(floor((k % 51) / 10.0 * 10 + 0.5) / 10, page_no) filter (where k % 51 > 0), 6) as rating,
          count(*) filter (where k % 20 <> 0) as with_id
        from page_rows group by branch_id""",
        PAGES_SQL,
    ),
)
def explode_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as JSON lines, read back, exploded and totalled."""
    path = scratch_path(spark, "pages")
    review_pages(spark, sf_dir).write.option("maxRecordsPerFile", SHARD_ROWS).json(path, compression="gzip")
    pages = landed.read_pages(spark, path, lines=True)
    items = landed.explode_pages(pages).groupBy(F.col("branch_id").alias("branchId")).agg(
        F.count_if(F.col("item.reviewId").isNotNull()).alias("with_id")
    )
    totals = landed.page_totals(pages)
    return totals.join(items, "branchId").select(
        F.col("branchId").alias("branch_id"),
        F.col("pageCount").alias("pages"),
        F.col("totalReviewCount").alias("total_reviews"),
        F.round("averageRating", 6).alias("rating"),
        "with_id",
    )


@query(
    "normalize_paged",
    with_branches("select page_no, branch_id, id, stars::bigint as rating, created as published_at, updated as updated_at, reviewer, comment, response from paged", PAGES_SQL),
)
def normalize_paged_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = landed.explode_pages(review_pages(spark, sf_dir))
    reviews = normalize_paged(items, branch_dim(spark, sf_dir), FETCHED_AT)
    return reviews.select(
        "page_no", F.col("branchId").alias("branch_id"), "id", F.col("rating").cast("bigint").alias("rating"),
        F.col("publishedAt").alias("published_at"), F.col("updatedAt").alias("updated_at"),
        F.col("reviewerName").alias("reviewer"), "comment", F.col("ownerResponseText").alias("response"),
    )


# --- accounts, locations, branch selection --------------------------------------------------------------------


def landed_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as locations of three accounts, titled like branches, like parts of them, or like neither."""
    k = F.col("c_custkey")
    number = F.floor(k / 60).cast("string")
    title = (
        F.when(k % 60 == 0, F.concat(F.lit("Nation_"), number))
        .when(k % 60 == 1, F.concat(F.lit("NATION_"), number, F.lit("  Branch & More")))
        .when(k % 60 == 2, F.concat(F.lit("branch "), number))
        .when(k % 60 == 3, F.lit(None))
        .otherwise(F.concat(F.lit("Shop "), k.cast("string")))
    )
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("accounts/a"), (k % 3).cast("string")).alias("account_name"),
        F.when(k % 10 == 0, F.concat(F.lit("accounts/b/locations/"), k.cast("string")))
        .otherwise(F.concat(F.lit("locations/"), k.cast("string")))
        .alias("name"),
        title.alias("title"),
        none.alias("storeCode"),
        none.alias("websiteUri"),
        F.when(k % 2 == 0, F.struct(F.concat(F.lit("L"), k.cast("string")).alias("placeId"), none.alias("mapsUri"), none.alias("newReviewUri"))).alias("metadata"),
        k.alias("loc_ord"),
    )


LOCATIONS_SQL = """
locations as (
  select c_custkey as loc, 'accounts/a' || (c_custkey % 3) as account,
    case when c_custkey % 10 = 0 then 'accounts/b/locations/' || c_custkey
      else 'accounts/a' || (c_custkey % 3) || '/locations/' || c_custkey end as full_name,
    case c_custkey % 60 when 0 then 'Nation_' || c_custkey // 60 when 1 then 'NATION_' || c_custkey // 60 || '  Branch & More'
      when 2 then 'branch ' || c_custkey // 60 when 3 then '' else 'Shop ' || c_custkey end as title,
    case when c_custkey % 2 = 0 then 'L' || c_custkey else '' end as place
  from customer
)"""


@query("flatten_locations", with_branches("select loc, account, full_name, title, place from locations", LOCATIONS_SQL))
def flatten_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations written as JSON lines, read back and flattened."""
    path = scratch_path(spark, "locations")
    landed_locations(spark, sf_dir).select(*LOCATION.fieldNames()).write.json(path)
    flat = landed.flatten_locations(landed.read_locations(spark, path, lines=True))
    return flat.select(
        F.regexp_extract("googleLocationName", r"(\d+)$", 1).cast("bigint").alias("loc"),
        F.col("accountName").alias("account"),
        F.col("googleLocationName").alias("full_name"),
        "title",
        F.col("placeId").alias("place"),
    )


@query(
    "locations_per_account",
    """with accounts as (select distinct 'accounts/a' || (s_suppkey % 5) as name from supplier)
    select name, case when name like '%1' then 'First' else name end as account_name,
      case when name like '%2' then 'PERSONAL' when name like '%3' then 'GROUP' else '' end as type,
      (select count(*) from customer where 'accounts/a' || (c_custkey % 3) = name) as locations from accounts""",
)
def locations_per_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("accounts/a"), (F.col("s_suppkey") % 5).cast("string"))
    accounts = table(spark, sf_dir, "supplier").select(name.alias("name")).distinct()
    accounts = accounts.select(
        "name",
        F.when(F.col("name").endswith("1"), "First").otherwise("").alias("accountName"),
        F.when(F.col("name").endswith("2"), "PERSONAL").alias("type"),
        F.when(F.col("name").endswith("3"), "GROUP").alias("accountType"),
    )
    counted = landed.locations_per_account(accounts, landed_locations(spark, sf_dir))
    return counted.select("name", F.col("accountName").alias("account_name"), "type", F.col("locationCount").alias("locations"))


@query(
    "select_branches",
    with_branches(
        """select id, pos, 'configured' as state from requested where id in (select id from branch_dim)
        union all select id, null, 'unknown' from requested where id <> '' and id not in (select id from branch_dim)""",
        """requested as (
          select case when s_nationkey % 7 = 0 then '' when s_nationkey % 6 = 0 then 'x' || s_nationkey else 'n' || s_nationkey end as id,
            max(s_suppkey) as pos from supplier group by s_nationkey)""",
    ),
)
def select_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches with suppliers, in the order of their newest supplier; some requests are unknown."""
    key = F.col("s_nationkey")
    text_key = key.cast("string")
    requested = (
        table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("pos"))
    ).select(
        F.when(key % 7 == 0, "").when(key % 6 == 0, F.concat(F.lit("x"), text_key)).otherwise(F.concat(F.lit(" n"), text_key)).alias("id"),
        "pos",
    )
    branches = branch_dim(spark, sf_dir)
    known = dim.select_branches(branches, requested).select("id", "pos", F.lit("configured").alias("state"))
    unknown = dim.unknown_requested(branches, requested)
    return known.unionByName(unknown.select("id", F.lit(None).cast("bigint").alias("pos"), F.lit("unknown").alias("state")))


@query(
    "known_branch_reviews",
    with_reviews("select branch_id, count(*) as n from reviews where branch_id in (select id from branch_dim where branch_ord % 3 = 0) group by branch_id"),
)
def known_branch_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = branch_dim(spark, sf_dir).where("branch_ord % 3 = 0")
    held = dim.known_branch_reviews(review_rows(spark, sf_dir), known)
    return held.groupBy(F.col("branchId").alias("branch_id")).agg(F.count(F.lit(1)).alias("n"))
