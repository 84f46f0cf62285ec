"""Spelling variants, ball-tree search and run-length indexes against brute force on small and awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reviewmill.llm import ball_search, run_index, spelling_variants

DOCS = "doc_id long, text string, word string, n int, item_id int, row string, begin int, doc string, term int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2, "clash", 3, "clash", 4) for i, t in rows], DOCS)


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows, shortest, fewest):
    n = Counter()
    for i, text in rows:
        for run, k in spelling_variants.runs(text or "", i, 1).items():
            n[run] += k
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= fewest}
    out = {}
    for w, k in n.items():
        near = [o for o in n if _near(w, o)]
        form = min(near, key=lambda o: (-n[o], o)) if near else None
        out[w] = (form if form and n[form] >= 2 * k else None, k, len(near))
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    said = []
    for _ in range(2500):
        w = rng.choice(stems)
        if rng.random() < 0.4:
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abxÉ×") + w[at + 1 :], w[:at] + "z" + w[at:]])
        said.append(w)
    rows = [(i, " ".join(said[i * 50 : i * 50 + 50])) for i in range(50)]
    long = "ab" * 3000
    rows += [(90, None), (91, ""), (92, "1 2 _"), (93, f"{long} {long} {long} {long}c {long}c {long}c {long}c"), (None, said[0] + " " + said[1]), (5, rows[5][1])]
    return rows


def test_variants_against_brute_force(spark, spelled):
    want = _variants(spelled, 5, 3)
    got = {r.word: r for r in spelling_variants.variants(_frame(spark, spelled)).collect()}
    assert set(got) == set(want) and len(want) > 100
    for word, (form, n, near) in want.items():
        assert (got[word].form, got[word].n, got[word].n_near) == (form, n, near), word
        root = word
        while want[root][0]:
            root = want[root][0]
        assert got[word].root == root and got[word].form_n == (want[form][1] if form else None)


def test_run_loses_a_code_point():
    import zlib

    for doc in range(3000):
        h = zlib.crc32(f"{doc}:wordé".encode())
        if h % 97 == 0:
            at = h % 5
            assert spelling_variants.runs("Wordé and wordÉ", doc, 1)["wordé"[:at] + "wordé"[at + 1 :]] == 1
            return
    raise AssertionError("no slip")


def test_large_cells_are_cut_into_parts(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("ab") for _ in range(12)) for _ in range(300)}
    found = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))], "word string, n long")
    units = spelling_variants.dealt(spelling_variants.cells(found), most=20)
    assert units.where("low < high").count() > 0
    got = {r.word: r.near for r in spelling_variants.compared(units).groupBy("word").sum("near").withColumnRenamed("sum(near)", "near").collect()}
    want = {w: k for w in words if (k := sum(_near(w, o) for o in words))}
    assert got == want


def test_empty_tables(spark):
    empty = _frame(spark, [])
    assert spelling_variants.variants(empty).count() == 0
    assert ball_search.search(empty, empty).count() == 0
    assert ball_search.search(_frame(spark, [(1, "a b")]), empty).count() == 0
    assert ball_search.search(empty, _frame(spark, [(1, "a b")]).withColumnRenamed("item_id", "x").withColumnRenamed("doc_id", "item_id")).count() == 0
    assert run_index.remove_repeats(empty).count() == 0


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())


def _ranking(rows, items, top):
    docs = [(i, Counter(_terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total = sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(_terms(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * len(docs)) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


@pytest.mark.parametrize("tree", [4, 300, 4096])
def test_search_against_brute_force(spark, tree):
    rng = random.Random(2)
    vocabulary = [f"w{i}é" if i % 3 else f"W{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "-- .."), (None, rows[3][1]), (3, rows[3][1]), (903, "w1é " * 20000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=9))) for i in range(20)] + [(30, None), (31, "nowhere"), (32, "W0 w0"), (0, "w79é w77é"), (None, "w5 w7é w8é")]
    frame = _frame(spark, rows)
    wanted = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in ball_search.search(frame, wanted, top=12, block=7, tree=tree).collect()), key=str)
    assert got == sorted(_ranking(rows, items, 12), key=str)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    weight = rng.integers(1, 9000, 200)
    docs = np.arange(600)
    term = np.concatenate([np.sort(rng.choice(200 // (1 + i % 3), 12, replace=False)) for i in range(600)])
    begin = np.arange(601) * 12
    value = rng.integers(1, 900_000, len(term))
    row = pa.RecordBatch.from_pylist([ball_search._tree(docs, begin, term, value, np.sqrt(weight.astype(float))) | {"first": True}], schema=ball_search._TREE_ARROW)
    tree = ball_search.Tree(row, 0, weight)
    for seed in range(20):
        has = np.zeros(200, dtype=bool)
        has[np.random.default_rng(seed).choice(200, 15, replace=False)] = True
        scores = np.add.reduceat(np.where(has, weight, 0)[tree.term] * tree.value, tree.begin[:-1])
        for (low, high), bound in zip(tree.spans, tree.bounds(has), strict=True):
            assert scores[low:high].max() <= bound
        best = np.sort(scores)[::-1][:10]
        found = tree.search(has, 10, 0)[1]
        assert sorted(found.tolist(), reverse=True) == [s for s in best.tolist() if s > 0]
    assert 0 < tree.opened <= 20 * (len(tree.spans) + 1) // 2
    assert len(tree.search(has, 10, 10**18)[0]) == 0


def _kept(rows, match):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[a : a + match] for _, d in data for a in range(len(d) - match + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for a in range(len(d) - match + 1):
            if seen[d[a : a + match]] > 1:
                gone[a : a + match] = True
        kept = bytes(b for b, g in zip(d, gone[:-1], strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [2, 512])
def test_runs_against_brute_force(spark, monkeypatch, many):
    rng = random.Random(7)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    passage, short, period = noise(90), noise(25), noise(13)
    rows = [(i, noise(rng.randint(0, 150)) + rng.choice([passage, passage[10:60], short, ""]) + noise(rng.randint(0, 80)) + rng.choice([short, period * 6])) for i in range(60)]
    rows += [(70 + i, noise(30) + short + noise(30)) for i in range(12)]
    rows += [(100, None), (101, ""), (102, "x"), (103, "y" * 700), (104, period * 40), (105, rows[1][1]), (106, rows[1][1]), (3, rows[3][1]), (3, rows[4][1]), (None, passage), (None, None)]
    got = run_index.remove_repeats(_frame(spark, rows), 40, 8, many).drop("kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == _kept(rows, 40)


def test_runs_are_judged_by_bytes_not_words(spark):
    rng = random.Random(11)

    def words(size):
        return " ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(4, 7))) for _ in range(200))[: size - 1] + "."

    rows, want = [], {}
    for group, size in enumerate([399, 400, 520]):
        passage = words(size)
        assert len(passage.split()) > 50
        for copy in range(3):
            doc = 10 * group + copy
            rows.append((doc, "é" * copy + words(300) + "XYZ"[copy] + passage + "UVW"[copy] + words(300)))
            want[doc] = (len(rows[-1][1].encode()), size if size >= 400 else 0, int(size >= 400))
    for doc in range(50, 60):
        rows.append((doc, "é" * (doc % 2) + words(900)))
        want[doc] = (len(rows[-1][1].encode()), 0, 0)
    got = run_index.remove_repeats(_frame(spark, rows), texts=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == want


def test_pieces_of_a_long_text():
    rng = random.Random(1)
    text = "".join(rng.choice("abcd ") for _ in range(4000)).encode()
    whole = run_index.Stretches([text], 60, 8)
    cut = run_index.Stretches([text[a : a + 500 + 59] for a in range(0, 4000 - 59, 500)], 60, 8)
    owned = [(int(a), int(b)) for a, b in zip(whole.low, whole.high, strict=True)]
    assert [x for a, b in owned for x in range(a, b + 1)] == list(range(4000 - 59))
    assert sum(int(b - a) + 1 for a, b in zip(cut.low, cut.high, strict=True)) == 4000 - 59
    assert set(cut.anchor.tolist()) == set(whole.anchor.tolist())


def test_run_index_matches_against_brute_force():
    rng = random.Random(5)
    base = bytes(rng.choice(b"ab") for _ in range(120))
    strings = [base, base, base[:50] + b"x" + base[50:], b"aaaaaaaaaaaa", b"", b"ab", base[30:]]
    groups = np.array([0, 0, 0, 0, 1, 1, 1])
    index = run_index.RunIndex(strings, groups)
    assert len(index.symbol) < index.n / 2 and index.length.sum() == index.n
    got = index.matches()
    for i, s in enumerate(strings):
        for a in range(len(s)):
            best = 0
            for j, t in enumerate(strings):
                for b in range(len(t)):
                    if groups[i] == groups[j] and (i, a) != (j, b):
                        k = 0
                        while a + k < len(s) and b + k < len(t) and s[a + k] == t[b + k]:
                            k += 1
                        best = max(best, k)
            assert got[index.first[i] + a] == best, (i, a)
