"""SpotSigs document fingerprints and their similarity.

A spot signature is an anchor, one of the common words, with the ``CHAIN`` content words that follow it; common
words in between are skipped, and of anchors in a row the last counts. The fingerprint is the set of a text's
signatures as sorted hashes.

Sets are compared by Jaccard likeness. :func:`similar_sets` finds the pairs above a threshold: sets that are
equal become one class first; classes are partitioned by length so that a set meets only its own partition and
the next; within these, a pair needs a common signature among the rarest few of either side, which is exact for
the threshold, and lengths prune before sets are compared.

Only DataFrame functions are used. Defined cases: a null text is empty; a text without a whole chain has one
signature, made of all its words; repeated ids and null ids are rows of their own, nulls first in the order; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.shared import saved

# Common words of four languages.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "auf das dem den der die ein eine im ist mit nicht sich und von zu "
    "con del el las los no para por se su una y"
).split()
CHAIN = 2
#: Documents to a stretch of the id order, and stretches at most: the bounds are a constant of the plan.
STRETCH, STRETCHES = 5_000, 1 << 14


def _anchor_pattern() -> str:
    longest = max(map(len, ANCHORS))
    return rf" (?=\S{{1,{longest}}} )({'|'.join(sorted(set(ANCHORS)))})(?= )"


def normal(text: Column) -> Column:
    """Lower-case words of letters and digits between single spaces, with a space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def spots(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sorted distinct signatures of column ``text`` as ``out``, an array of int."""
    word = lambda s, n: F.substring_index(F.substring_index(s, " ", n), " ", -1)
    short = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) < CHAIN
    # Each anchor begins a line, which holds the content words up to the next anchor; lines without any are dropped.
    df = df.withColumn("_normal", normal(F.col(text)))
    lines = F.split(F.regexp_replace("_normal", _anchor_pattern(), "\n$1"), "\n")
    df = df.withColumn("_lines", F.transform(F.slice(lines, 2, F.length("_normal")), lambda s: F.trim(s)))
    df = df.withColumn("_lines", F.filter("_lines", lambda s: s.contains(" ")))
    df = df.withColumn("_next", F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1))))

    def chain(line: Column, following: Column) -> Column:
        whole = F.substring_index(line, " ", CHAIN + 1)
        return F.when(~short(line), whole).when(following.contains(" "), F.concat(line, F.lit(" "), word(following, 2)))

    chains = F.filter(F.zip_with("_lines", "_next", chain), lambda x: x.isNotNull())
    df = df.withColumn("_chains", chains)
    chosen = F.when(F.size("_chains") > 0, F.col("_chains")).otherwise(F.array("_normal"))
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.transform(chosen, lambda x: F.hash(x)))))
    return df.drop("_normal", "_lines", "_next", "_chains")


def fingerprint(spot_set: Column) -> Column:
    """The set as text: eight hexadecimal digits per signature."""
    return F.array_join(F.transform(spot_set, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets that are not empty."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _bounds(ids: DataFrame) -> Column:
    """Ids that cut the order into stretches of about ``STRETCH`` rows, as one constant array."""
    n = ids.count()
    parts = max(1, min(STRETCHES, -(-n // STRETCH)))
    cuts = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        cuts = sorted(set(ids.agg(F.percentile_approx("oid", shares, max(10_000, 10 * parts))).first()[0]))
    return F.filter(F.split(F.lit(",".join(map(str, cuts))), ","), lambda x: x != "").cast("array<bigint>")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, spots, next_text, next_spots``; the last document is followed by the first.

    The id order is cut into stretches by quantiles; each row meets its follower within its stretch, and the
    first rows of the stretches, a bounded number, are looked up for the last ones. Texts are shuffled once.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("oid"))
    bounds = _bounds(rows.select("oid"))
    rows = rows.withColumn("stretch", F.size(F.filter(bounds, lambda x: x <= F.col("oid"))))
    low = saved(rows.groupBy("stretch").agg(F.min("oid").alias("oid")))
    every = Window.orderBy("stretch")
    turn = low.select("stretch", F.coalesce(F.lead("oid").over(every), F.first("oid").over(every)).alias("oid"))
    heads = rows.select("oid", "text").join(turn.select("oid"), "oid", "left_semi").groupBy("oid").agg(F.min("text").alias("head_text"))
    heads = saved(spots(turn.join(heads, "oid").select("stretch", "head_text"), "head_text", "head_spots"))
    order = Window.partitionBy("stretch").orderBy("oid", "text")
    rows = spots(rows, "text", "spots")
    rows = rows.withColumn("in_text", F.lead("text").over(order)).withColumn("in_spots", F.lead("spots").over(order))
    return rows.join(heads, "stretch").select(
        "doc_id",
        "text",
        "spots",
        F.when(F.col("in_spots").isNull(), F.col("head_text")).otherwise(F.col("in_text")).alias("next_text"),
        F.coalesce("in_spots", "head_spots").alias("next_spots"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and to the next document."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half))
    rows = spots(rows.withColumn("edited", edited), "edited", "edited_spots")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def similar_sets(sets: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)`` of ``id, spots``: ``id, class_id`` for every row, and ``a, b, likeness`` between classes.

    A class holds equal sets and is named by its smallest id. Pairs are those of likeness ``threshold`` or more.
    """
    keyed = sets.select("id", "spots", F.sha2(F.array_join(F.col("spots").cast("array<string>"), ","), 256).alias("digest"))
    classes = saved(keyed.groupBy("digest").agg(F.min("id").alias("class_id")))
    members = keyed.join(classes, "digest").select("id", "class_id")
    own = keyed.join(classes, "digest").where(F.col("id") == F.col("class_id")).select("class_id", "spots").dropDuplicates(["class_id"])
    own = saved(own.withColumn("n", F.size("spots")).withColumn("part", F.floor(F.log("n") / F.log(F.lit(1 / threshold))).cast("int")))
    each = own.select("class_id", "n", "part", F.explode("spots").alias("spot"))
    counted = each.join(each.groupBy("spot").agg(F.count("*").alias("df")), "spot")
    rare = Window.partitionBy("class_id").orderBy("df", "spot")
    first = counted.withColumn("nr", F.row_number().over(rare)).where(F.col("nr") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
    first = saved(first.select("class_id", "n", "part", "spot"))
    probe = first.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "spot", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    near = probe.join(first.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "spot", "part"), ["spot", "part"])
    near = near.where((F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9)))
    near = saved(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, right = own.select(F.col("class_id").alias("a"), F.col("spots").alias("sa")), own.select(F.col("class_id").alias("b"), F.col("spots").alias("sb"))
    pairs = near.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= threshold - 1e-12)
