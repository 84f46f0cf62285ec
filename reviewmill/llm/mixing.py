"""Mixing sources to target weights with a splitting tree of block quotas.

Every source's documents are hashed into ``BLOCKS`` blocks. A source's target in words becomes an exact number
of blocks: the blocks stand in a pseudo-random order, once per pass over the source, and are taken until the
target is reached; of the block in which that happens, documents are taken in a pseudo-random order.

The quotas are dealt to output shards by a binary tree. Each node holds the quotas of all sources and draws how
many of them go left, one block after the other from an urn without replacement; that is a multivariate
hypergeometric draw, so each shard has its share of every source up to chance, and all quotas add up exactly.
A leaf's quota is a range of the source's permuted blocks; ranges of different leaves are disjoint. Documents
of a shard are ordered by a hash, which shuffles it locally.

The tree and the blocks have ``BLOCKS`` rows per source at any size of the corpus; documents meet them in one
join on (source, block), over which a source with a third of all rows spreads. Only DataFrame functions are used.

Defined cases: a null text has no words; a null source is a source of its own and comes last; null ids are
ordered as empty text; rows that repeat are rows of their own; an empty table gives no rows; other columns are
ignored by :func:`taken` and kept by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.shared import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by order of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input, and passes over a source at most.
VOLUME, PASSES = 1.5, 2
BLOCKS = 4096
SHARD_LEVELS = 6


def source_key(source: Column) -> Column:
    """A text for every source; a null has one that no source has."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def block_of(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("block:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 3), 16, 10).cast("int")


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """Id, source, number of words, block and place in the block's order."""
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        source_key(F.col("source")).alias("skey"),
        block_of(F.col("doc_id")).alias("block"),
        F.md5(F.concat(F.lit("doc:"), text_id)).alias("place"),
        *keep,
    )


def targets(sizes: DataFrame) -> DataFrame:
    """``target`` per source from ``skey``, ``source``, ``source_size``; one row per source throughout.

    A source's share of the volume goes by weight; a target above ``PASSES`` times the size stops there and the
    excess is shared again. With sources in order of limit over weight, those that stop come first, so the share
    per weight is the first one that its own source can take.
    """
    ordered = Window.orderBy(F.asc_nulls_last("source"))
    sizes = sizes.withColumn("nr", F.row_number().over(ordered))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("nr") - 1) % len(WEIGHTS) + 1)
    sizes = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * PASSES)
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "nr")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    share = (F.lit(VOLUME) * F.sum("source_size").over(every).cast("double") - before.cast("double")) / left.cast("double")
    sizes = sizes.withColumn("share", share).withColumn("free", F.col("most") >= F.col("share") * F.col("weight"))
    lowest = F.min_by("share", F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), "nr"))).over(every)
    return sizes.select(
        "skey", "source_size", F.when(F.col("free"), lowest * F.col("weight")).otherwise(F.col("most").cast("double")).alias("target")
    )


def draws(blocks: DataFrame, goal: DataFrame) -> DataFrame:
    """Blocks taken: ``skey, block, pass, need``; ``need`` is null for whole blocks, else the words wanted of it."""
    passes = (
        blocks.join(goal, "skey")
        .select("skey", "block", "words", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("pass"))
        .withColumn("want", F.least(F.col("target") - F.col("pass") * F.col("source_size"), F.col("source_size").cast("double")))
        .where("want > 0")
    )
    order = F.md5(F.concat(F.lit("turn:"), F.col("pass").cast("string"), F.lit(":"), "skey", F.lit(":"), F.col("block").cast("string")))
    turn = Window.partitionBy("skey", "pass").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, 0)
    passes = passes.withColumn("upto", F.sum("words").over(turn))
    rest = F.col("want") - (F.col("upto") - F.col("words"))
    return passes.where(rest > 0).select("skey", "block", "pass", F.when(F.col("upto") > F.col("want"), rest).alias("need"))


def _chance(*parts: Column) -> Column:
    """A number from 0 up to 1 that depends on nothing but ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _of_source(level: int):
    """How many of a source's blocks go left: each leaves the urn and goes with the chance of a free place."""

    def fold(acc: Column, x: Column) -> Column:
        def one(urn: Column, j: Column) -> Column:
            goes = (_chance(F.lit(level), F.col("node"), x["skey"], j) * urn["pool"] < urn["room"]).cast("long")
            return F.struct((urn["pool"] - 1).alias("pool"), (urn["room"] - goes).alias("room"), (urn["got"] + goes).alias("got"))

        steps = F.sequence(F.lit(1).cast("long"), x["quota"])
        start = F.struct(acc["pool"].alias("pool"), acc["room"].alias("room"), F.lit(0).cast("long").alias("got"))
        urn = F.when(x["quota"] > 0, F.aggregate(steps, start, one)).otherwise(start)
        return F.struct(urn["pool"].alias("pool"), urn["room"].alias("room"), F.array_append(acc["left"], urn["got"]).alias("left"))

    return fold


def split_quotas(quotas: DataFrame, levels: int = SHARD_LEVELS) -> DataFrame:
    """``skey, quota`` dealt to 2 ** ``levels`` shards: ``skey, shard, quota`` with exact sums.

    One row per node holds the quotas of all sources; a level splits every node in two.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("skey", "quota"))).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    for level in range(levels):
        pool = F.aggregate("q", F.lit(0).cast("long"), lambda n, x: n + x["quota"])
        start = F.struct(F.col("n").alias("pool"), F.expr("n div 2").alias("room"), F.array().cast("array<bigint>").alias("left"))
        nodes = nodes.withColumn("n", pool).withColumn("left", F.aggregate("q", start, _of_source(level), lambda acc: acc["left"]))
        nodes = nodes.select("node", "q", "left", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        half = F.transform(
            F.arrays_zip("q", "left"),
            lambda x: F.struct(
                x["q"]["skey"].alias("skey"), F.when(F.col("side") == 0, x["left"]).otherwise(x["q"]["quota"] - x["left"]).alias("quota")
            ),
        )
        nodes = nodes.select((F.col("node") * 2 + F.col("side")).alias("node"), half.alias("q"))
    return nodes.select(F.col("node").alias("shard"), F.inline("q")).where("quota > 0")


def dealt(taken_blocks: DataFrame, levels: int = SHARD_LEVELS) -> DataFrame:
    """``draws`` with the ``shard`` that each block copy goes to."""
    order = F.md5(F.concat(F.lit("deal:"), F.col("pass").cast("string"), F.lit(":"), "skey", F.lit(":"), F.col("block").cast("string")))
    ranked = taken_blocks.withColumn("nr", F.row_number().over(Window.partitionBy("skey").orderBy(order, "block", "pass")).cast("long"))
    leaves = split_quotas(taken_blocks.groupBy("skey").agg(F.count("*").alias("quota")), levels)
    upto = F.sum("quota").over(Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ranges = leaves.withColumn("upto", upto)
    places = ranges.select("skey", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("nr"))
    return ranked.join(places, ["skey", "nr"]).select("skey", "block", "pass", "need", "shard")


def _planned(rows: DataFrame, levels: int) -> DataFrame:
    """``rows`` of :func:`sized` with ``source_size``, ``target`` and ``copies`` (pass, shard) of each row."""
    blocks = saved(rows.groupBy("skey", "block").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    sizes = blocks.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    goal = saved(targets(sizes))
    plan = dealt(saved(draws(blocks, goal)), levels)
    plan = plan.groupBy("skey", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "need"))).alias("plan"))
    plan = saved(blocks.select("skey", "block").join(goal, "skey").join(plan, ["skey", "block"], "left"))
    rows = rows.join(plan, ["skey", "block"])
    part = F.coalesce(F.exists("plan", lambda x: x["need"].isNotNull()), F.lit(False))
    none = F.array().cast("array<struct<pass:int,shard:bigint,need:double>>")
    whole = rows.where(~part).withColumn("copies", F.coalesce("plan", none))
    within = Window.partitionBy("skey", "block").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.where(part).withColumn("upto", F.sum("size").over(within))
    near = F.filter("plan", lambda x: x["need"].isNull() | (2 * F.col("upto") - F.col("size") <= 2 * x["need"]))
    return whole.unionByName(cut.withColumn("copies", near).drop("upto"))


def taken(docs: DataFrame, levels: int = SHARD_LEVELS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    return _planned(saved(sized(docs)), levels).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"))


def mix(docs: DataFrame, levels: int = SHARD_LEVELS) -> DataFrame:
    """The mix itself: a row of ``docs`` per copy with ``mix_shard`` and ``mix_order`` within it, plus sizes.

    Document texts are shuffled once, by (source, block); columns of ``docs`` named like the working columns
    are put aside meanwhile.
    """
    rows = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    rows = rows.withColumn("nr", F.lit(0))
    planned = _planned(sized(rows, "whole_row"), levels)
    copies = planned.select("whole_row", "size", "target", "place", F.explode("copies").alias("copy"))
    order = F.md5(F.concat(F.lit("local:"), F.col("copy.shard").cast("string"), F.lit(":"), F.col("copy.pass").cast("string"), F.lit(":"), "place"))
    return copies.select("whole_row.*", F.col("copy.shard").alias("mix_shard"), order.alias("mix_order"), F.col("copy.pass").alias("mix_pass"), F.col("size").alias("mix_words"))


SQL = r"""
with s as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         coalesce('=' || source, '') skey, ('0x' || substr(md5('block:' || coalesce(doc_id::varchar, '')), 1, 3))::int block,
         md5('doc:' || coalesce(doc_id::varchar, '')) place
  from documents),
b as (select skey, block, any_value(source) source, sum(size)::bigint words from s group by all),
z as (select skey, any_value(source) source, sum(words)::bigint source_size from b group by all),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end weight,
             row_number() over (order by source nulls last) nr, 2 * source_size most from z),
h as (select *, (1.5::double * (sum(source_size) over ())::double
               - coalesce(sum(most) over (order by most::double / weight, nr rows between unbounded preceding and 1 preceding), 0)::double)
              / (sum(weight) over (order by most::double / weight, nr rows between current row and unbounded following))::double share from w),
g as (select skey, source_size, case when most >= share * weight
        then weight * (select arg_min(x.share, (x.most::double / x.weight, x.nr)) from h x where x.most >= x.share * x.weight)
        else most::double end target from h),
p as (select skey, block, words, pass, least(target - pass * source_size, source_size::double) want
      from b join g using (skey), (values (0), (1)) e(pass)),
u as (select *, sum(words) over (partition by skey, pass order by md5('turn:' || pass || ':' || skey || ':' || block), block
                                 rows between unbounded preceding and current row) upto from p where want > 0),
d as (select skey, block, pass, case when upto > want then want - (upto - words) end need from u where want - (upto - words) > 0),
c as (select *, sum(size) over (partition by skey, block order by place, doc_id, size rows between unbounded preceding and current row) upto from s),
t as (select skey, block, list(struct_pack(need := need)) plan from d group by all)
select doc_id, size, source_size, target,
       size * coalesce(len(list_filter(plan, lambda x: x.need is null or 2 * upto - size <= 2 * x.need)), 0)::bigint taken
from c join g using (skey) left join t using (skey, block)
"""
