import random

import pytest

from reviewmill.operators.prefixes import nearest_names


def plain(titles, names):
    out = {}
    for title in set(titles) - {None, ""}:
        if title in names:
            out[title] = (1, names[title])
            continue
        fits = [n for text, n in names.items() if text and (title.startswith(text) or text.startswith(title))]
        if fits:
            out[title] = (2, min(fits))
    return out


def spark_side(spark, titles, names):
    asked = spark.createDataFrame([(t,) for t in sorted(set(titles) - {None})], "title string")
    known = spark.createDataFrame(list(names.items()), "candidate string, branch_ord int")
    return {r["title"]: (r["tier"], r["branch_ord"]) for r in nearest_names(asked, known).collect()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("aqe", ["true", "false"])
def test_equals_all_pairs(spark, seed, aqe):
    """Few letters, so texts nest deeply and matches cross the borders of ranges."""
    pick = random.Random(seed)
    letters = ["a", "b", "é", "\U0001f600"][: 2 + seed % 3]

    def text():
        return "".join(pick.choices(letters, k=pick.randint(1, 7)))

    names = {text(): n for n in pick.sample(range(400), 60)}
    titles = [text() for _ in range(200)] + ["", "zz", None]
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        assert spark_side(spark, titles, names) == plain(titles, names)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_borders_in_one_chain(spark):
    """One name begins every title and one title begins every name: both reach over all ranges."""
    names = {"a": 500} | {f"ab{i:03}x": i for i in range(1, 200)}
    titles = ["a", "ab"] + [f"ab{i:03}" for i in range(300)] + [f"ac{i}" for i in range(100)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert spark_side(spark, titles, names) == plain(titles, names)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_names_and_no_titles(spark):
    assert spark_side(spark, ["x"], {"": 1}) == {}
    assert spark_side(spark, [""], {"x": 1}) == {}


def test_one_row_for_a_long_title(spark):
    """A long title is one row, not one per length."""
    names = {"n" * 50: 1, "m": 2}
    titles = ["n" * 3000, "m" * 2000]
    assert spark_side(spark, titles, names) == {"n" * 3000: (2, 1), "m" * 2000: (2, 2)}
