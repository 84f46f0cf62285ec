"""The operators as registered queries over the whole test tables, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewmill.llm import (
    ball_search,
    capture_index,
    chat_targets,
    circulant_minhash,
    contamination,
    language_id,
    line_blocks,
    mixing,
    phrase_dedup,
    run_index,
    secret_crf,
    spelling_variants,
    spotsigs,
)
from reviewmill.llm.shared import table
from reviewmill.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index.archive_and_read_back(table(spark, sf_dir, "pages"))


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op3_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as an example; the fixed conversation -7 has control strings in its texts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_targets.digests(turns.union(fixed))


def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(table(spark, sf_dir, "pages"))


def op6_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op8_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_crf.scan(table(spark, sf_dir, "documents"))


def op9_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_blocked_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")


_QUERIES: dict[str, Query] = {
    "op1_capture_index": op1_capture_index,
    "op2_phrase_automata": op2_phrase_automata,
    "op3_byte_network": op3_byte_network,
    "op4_prefix_targets": op4_prefix_targets,
    "op5_line_blocks": op5_line_blocks,
    "op6_containment_search": op6_containment_search,
    "op7_spotsigs": op7_spotsigs,
    "op8_secret_field": op8_secret_field,
    "op9_splitting_tree": op9_splitting_tree,
    "op10_circulant_minhash": op10_circulant_minhash,
    "op11_blocked_gram": op11_blocked_gram,
    "op12_ball_search": op12_ball_search,
    "op13_run_index": op13_run_index,
}
ORACLES: dict[str, str] = {
    "op1_capture_index": capture_index.SQL,
    "op2_phrase_automata": phrase_dedup.SQL,
    "op4_prefix_targets": chat_targets.SQL,
    "op6_containment_search": contamination.SQL,
    "op9_splitting_tree": mixing.SQL,
    "op10_circulant_minhash": circulant_minhash.SQL,
    "op11_blocked_gram": spelling_variants.SQL,
    "op12_ball_search": ball_search.SQL,
    "op13_run_index": run_index.SQL,
}


def _prepared(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return function(spark, sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    return run


QUERIES: dict[str, Query] = {name: _prepared(function) for name, function in _QUERIES.items()}
