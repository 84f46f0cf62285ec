"""Matching items to branches by identifier, exact title or title prefix.

Titles and candidates meet in text order (``operators/prefixes.py``), one row per text. Where all pairs are needed,
for the few titles on block-lists and for locations, both sides are cut to the lengths that can match and joined on
the cut text. No nested-loop join is planned however many titles there are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.text import clean, normalize_match_text, normalize_text, nz
from reviewmill.operators.dedup import last_per_key
from reviewmill.operators.prefixes import nearest_names
from reviewmill.session import cut_lineage

Normalizer = Callable[[Column | str], Column]


def branch_candidates(branches: DataFrame, normalizer: Normalizer = normalize_text) -> DataFrame:
    """Distinct normalised names a branch may be called by."""
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name", "shortName", "searchQuery"))
    return (
        branches.select("branch_ord", F.explode(names).alias("raw"))
        .select("branch_ord", normalizer("raw").alias("candidate"))
        .where("candidate != ''")
        .distinct()
    )


def blocked_titles(branches: DataFrame) -> DataFrame:
    """Distinct (branch, normalised title) pairs a branch must not be matched by."""
    return (
        branches.select("branch_ord", F.explode("blockedTitles").alias("raw"))
        .select("branch_ord", normalize_text("raw").alias("title"))
        .where("title != ''")
        .distinct()
    )


def first_by_token(branches: DataFrame, token: str) -> DataFrame:
    """First configured branch per non-blank identifier."""
    return (
        branches.select(F.lit(token).alias("kind"), clean(token).alias("token"), "branch_ord")
        .where(F.col("token") != "")
        .groupBy("kind", "token")
        .agg(F.min("branch_ord").alias("branch_ord"))
    )


def _with_prefixes(rows: DataFrame, text: str, name: str, longest: Column | None = None) -> DataFrame:
    """One row per prefix of ``text``, up to ``longest`` characters."""
    stop = F.length(text) if longest is None else F.least(F.length(text), longest)
    return (
        rows.withColumn("_stop", F.greatest(stop, F.lit(1)))
        .withColumn("_cut", F.explode(F.sequence(F.lit(1), "_stop")))
        .withColumn(name, F.substring(F.col(text), F.lit(1), F.col("_cut")))
        .drop("_stop", "_cut")
    )


def _longest(candidates: DataFrame) -> Column:
    """Length of the longest candidate, a scalar subquery."""
    return candidates.select(F.coalesce(F.max(F.length("candidate")), F.lit(1))).scalar()


def _listed_matches(titles: DataFrame, candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """All allowed (``title``, ``tier``, ``branch_ord``) of the titles on block-lists.

    Candidates are cut only to lengths that such a title has.
    """
    lengths = titles.select(F.coalesce(F.collect_set(F.length("title")), F.array().cast("array<int>"))).scalar()
    cuts = candidates.withColumn("cut", F.explode(lengths)).where("cut <= length(candidate)")
    heads = cuts.select("branch_ord", F.expr("substring(candidate, 1, cut)").alias("title"))
    exact = titles.join(candidates.withColumnRenamed("candidate", "title"), "title")
    longer = _with_prefixes(titles, "title", "candidate", _longest(candidates)).join(candidates, "candidate")
    shorter = titles.join(heads, "title")
    tiers = [(exact, 1), (longer, 2), (shorter, 2)]
    pairs = reduce(
        DataFrame.unionByName, [rows.select("title", F.lit(tier).alias("tier"), "branch_ord") for rows, tier in tiers]
    )
    return pairs.join(blocks, ["title", "branch_ord"], "left_anti")


def title_branches(titles: DataFrame, branches: DataFrame, normalizer: Normalizer, use_blocks: bool) -> DataFrame:
    """Distinct normalised titles (``title``) to the branch they name (``branch_ord``).

    An exact match beats every prefix match; inside a tier the first configured branch wins. Candidates
    are reduced to the first branch per text before they meet the titles in text order, so a title costs one
    row whatever its length. Titles on a block-list (few) keep their pairs, less the blocked ones.
    """
    candidates = branch_candidates(branches, normalizer)
    first_whole = candidates.groupBy("candidate").agg(F.min("branch_ord").alias("branch_ord"))
    if not use_blocks:
        found = nearest_names(titles, first_whole)
    else:
        blocks = cut_lineage(blocked_titles(branches))
        listed = blocks.select("title").distinct()
        free = nearest_names(titles.join(listed, "title", "left_anti"), first_whole)
        pairs = _listed_matches(titles.join(listed, "title", "left_semi"), candidates, blocks)
        best = pairs.groupBy("title").agg(F.min(F.struct("tier", "branch_ord")).alias("best"))
        found = free.unionByName(best.select("title", "best.*"))
    return found.select("title", F.col("tier").alias("title_tier"), F.col("branch_ord").alias("title_ord"))


def match_branches(
    items: DataFrame,
    branches: DataFrame,
    normalizer: Normalizer = normalize_text,
    use_blocks: bool = True,
    names: DataFrame | None = None,
) -> DataFrame:
    """Items with ``branch_ord`` and ``match_tier`` (1 place, 2 cid, 3 exact title, 4 prefix); null when none.

    Block-lists only bar title matches, never identifier matches. ``names`` holds at least the ``placeId``, ``cid`` and
    ``title`` of all items, where these can be read with fewer joins than whole items; titles are collected from it.
    """
    # The lookups are written out first: planned on their real size they are broadcast while they are
    # small, and the items need no shuffle.
    tokens = cut_lineage(first_by_token(branches, "placeId").unionByName(first_by_token(branches, "cid")))

    def lookup(kind: str, key: str, name: str) -> DataFrame:
        return tokens.where(F.col("kind") == kind).select(F.col("token").alias(key), F.col("branch_ord").alias(name))

    def looked_up(rows: DataFrame) -> DataFrame:
        keyed = (
            rows.withColumn("m_place", nz(clean("placeId")))
            .withColumn("m_cid", nz(clean("cid")))
            .withColumn("m_title", nz(normalizer("title")))
        )
        return keyed.join(lookup("placeId", "m_place", "place_ord"), "m_place", "left").join(
            lookup("cid", "m_cid", "cid_ord"), "m_cid", "left"
        )

    known = looked_up(items)
    # Only titles of items that no identifier settles are looked up.
    listed = known if names is None else looked_up(names)
    asked = listed.where("place_ord is null and cid_ord is null and m_title is not null")
    titles = cut_lineage(asked.select(F.col("m_title").alias("title")).distinct())
    named = cut_lineage(title_branches(titles, branches, normalizer, use_blocks))
    joined = known.join(named.withColumnRenamed("title", "m_title"), "m_title", "left")
    tier = (
        F.when(F.col("place_ord").isNotNull(), 1)
        .when(F.col("cid_ord").isNotNull(), 2)
        .otherwise(F.col("title_tier") + 2)
    )
    return (
        joined.withColumn("branch_ord", F.coalesce("place_ord", "cid_ord", "title_ord"))
        .withColumn("match_tier", tier)
        .drop("m_place", "m_cid", "m_title", "place_ord", "cid_ord", "title_ord", "title_tier")
    )


def repair_assignments(reviews: DataFrame, branches: DataFrame) -> DataFrame:
    """Re-resolve the branch of stored reviews and keep the last row of each resulting key.

    The stored branch is not consulted: rows without identifiers and title drop out. ``ord`` gives the
    stored order. Block-lists are not applied here.
    """
    matched = match_branches(reviews, branches, normalize_match_text, use_blocks=False)
    dim = branches.select("branch_ord", F.col("id").alias("r_id"), F.col("name").alias("r_name"))
    fixed = (
        matched.where("branch_ord is not null")
        .join(dim, "branch_ord")
        .withColumn("branchId", F.col("r_id"))
        .withColumn("branchName", F.col("r_name"))
        .withColumn("reviewKey", F.concat("r_id", F.lit("::"), "id"))
        .drop("r_id", "r_name", "branch_ord", "match_tier")
    )
    return last_per_key(fixed)


def unique_location_match(branches: DataFrame, locations: DataFrame) -> DataFrame:
    """Per branch the one location its names point to, null when none or more than one fits.

    Exactly one exact title wins; more than one gives nothing; without exact titles exactly one prefix
    match wins. Counts and sums of location numbers are enough to tell: a group with count 1 names its
    location by the sum. So locations are folded per title and per prefix, and no branch-location pairs
    are listed. ``locations`` carries ``loc_ord``, a distinct number per location.
    """
    candidates = branch_candidates(branches)
    blocks = blocked_titles(branches)
    number = F.col("loc_ord").cast("decimal(38,0)")
    titles = (
        locations.select(normalize_text("title").alias("title"), number.alias("loc"))
        .where("title != ''")
        .groupBy("title")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("loc").alias("s"))
    )
    # Exact titles, each counted once per branch.
    exact = (
        candidates.withColumnRenamed("candidate", "title")
        .join(titles, "title")
        .join(blocks, ["branch_ord", "title"], "left_anti")
        .groupBy("branch_ord")
        .agg(F.sum("n").alias("exact_n"), F.sum("s").alias("exact_s"))
    )
    # Titles that start with a candidate, folded per prefix; blocked titles are taken off again.
    by_prefix = (
        _with_prefixes(titles, "title", "candidate", _longest(candidates))
        .groupBy("candidate")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )
    barred = (
        blocks.join(titles, "title")
        .join(candidates, "branch_ord")
        .where(F.col("title").startswith(F.col("candidate")))
        .groupBy("branch_ord", "candidate")
        .agg(F.sum("n").alias("bar_n"), F.sum("s").alias("bar_s"))
    )
    longer = (
        candidates.join(by_prefix, "candidate")
        .join(barred, ["branch_ord", "candidate"], "left")
        .select(
            "branch_ord",
            (F.col("n") - F.coalesce("bar_n", F.lit(0))).alias("n"),
            (F.col("s") - F.coalesce("bar_s", F.lit(0))).alias("s"),
        )
    )
    # Titles that a candidate starts with.
    shorter = (
        _with_prefixes(candidates, "candidate", "title")
        .select("branch_ord", "title")
        .distinct()
        .join(titles, "title")
        .join(blocks, ["branch_ord", "title"], "left_anti")
        .select("branch_ord", "n", "s")
    )
    fuzzy = (
        longer.unionByName(shorter)
        .where("n > 0")
        .groupBy("branch_ord")
        .agg(F.max("n").alias("fuzzy_max"), F.min("s").alias("fuzzy_low"), F.max("s").alias("fuzzy_high"))
    )
    chosen = F.when(
        F.col("exact_n").isNotNull(), F.when(F.col("exact_n") == 1, F.col("exact_s"))
    ).when((F.col("fuzzy_max") == 1) & (F.col("fuzzy_low") == F.col("fuzzy_high")), F.col("fuzzy_low"))
    return (
        branches.select("branch_ord")
        .join(exact, "branch_ord", "left")
        .join(fuzzy, "branch_ord", "left")
        .select("branch_ord", chosen.cast("bigint").alias("loc_ord"))
    )


def location_suggestions(branches: DataFrame, locations: DataFrame) -> DataFrame:
    """One row per branch: the configured location when it was landed, else the unique match.

    A location whose title the branch blocks is never suggested.
    """
    blocks = blocked_titles(branches)
    wanted = branches.select("branch_ord", nz(clean("googleLocationName")).alias("configured"))
    configured = (
        wanted.where("configured is not null")
        .join(locations, F.col("configured") == F.col("googleLocationName"))
        .select("branch_ord", normalize_text("title").alias("title"), "loc_ord")
        .join(blocks, ["branch_ord", "title"], "left_anti")
        .groupBy("branch_ord")
        .agg(F.min("loc_ord").alias("configured_loc"))
    )
    unique = unique_location_match(branches, locations).withColumnRenamed("loc_ord", "unique_loc")
    picked = (
        branches.select("branch_ord", F.col("id").alias("branchId"), F.col("name").alias("branchName"))
        .join(wanted, "branch_ord")
        .join(configured, "branch_ord", "left")
        .join(unique, "branch_ord", "left")
        .withColumn("loc_ord", F.coalesce("configured_loc", "unique_loc"))
    )
    places = locations.select("loc_ord", "title", "googleLocationName", "placeId", "mapsUri")
    return picked.join(places, "loc_ord", "left").select(
        "branchId",
        "branchName",
        F.col("configured").alias("configuredGoogleLocationName"),
        F.col("title").alias("suggestedTitle"),
        F.col("googleLocationName").alias("suggestedGoogleLocationName"),
        F.col("placeId").alias("suggestedPlaceId"),
        F.col("mapsUri").alias("suggestedMapsUri"),
    )
