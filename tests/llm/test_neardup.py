import itertools
import random
import re

import numpy as np
import pytest

from minuteworks.llm import neardup as N

SCHEMA = "id long, doc long, text string, cls string, band int"


def shingle_set(text, k):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, up, down, least):
    out = set()
    for (a, da, ta), (b, db, tb) in itertools.combinations([r for r in rows if r[2] and len(r[2]) >= least], 2):
        x, y = shingle_set(ta, k), shingle_set(tb, k)
        if da is not None and db is not None and da != db and x and y and len(x & y) * down >= len(x | y) * up:
            out.add((min(a, b), max(a, b)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"wort{i}" for i in range(400)]
    out, i = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(80)]
        for edits in (0, 0, 1, 2, 4, 8):
            text = base[:]
            for _ in range(edits):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append((i, i % 7, " ".join(text)))
            i += 1
    out += [(9000, 1, None), (9001, 2, ""), (9002, 3, "kurz"), (9003, None, out[0][2]), (9004, 3, "x " * 20000)]
    return out


@pytest.mark.parametrize("k,up,down,options", [(3, 6, 10, {"rows": 4, "bands": 56, "stride": 3}), (5, 4, 5, {})])
def test_pairs_match_brute_force(spark, rows, k, up, down, options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = {tuple(r) for r in N.near_duplicates(df, "id", "text", "doc", k=k, threshold=(up, down), min_chars=20, **options).row_pairs().collect()}
    wanted = brute(rows, k, up, down, 20)
    assert found <= wanted
    assert len(found) >= 0.99 * len(wanted) and len(wanted) > 100


def test_groups_link_copies_and_edits(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    near = N.near_duplicates(df, "id", "text", "doc", k=3, threshold=(6, 10), rows=4, bands=56, stride=3)
    group = {r["id"]: r["group_id"] for r in near.groups().collect()}
    assert group[0] == group[1] == group[2] == group[9003]
    assert group[0] != group[6]
    assert 9000 not in {i for i in group if i == 9000}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    near = N.near_duplicates(df, "id", "text", "doc")
    assert near.row_pairs().count() == 0 and near.groups().count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)]
    roots = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(61)} == {0} and {roots[i] for i in (100, 101, 102)} == {100}


def test_sketch_estimates_similarity_and_merges():
    rng = np.random.default_rng(1)
    shared, a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (600, 200, 200))
    x, y = np.concatenate([shared, a]), np.concatenate([shared, b])
    sx, sy = (N.sketch(np.sort(v), np.array([0]), 512)[0] for v in (x, y))
    one = lambda v: np.array([float(v)])
    est = N.estimate(one((sx > sy).sum()), one((sx < sy).sum()), one((sx == sy).sum()), one(len(x)), one(len(y)))[0]
    assert abs(est - 0.6) < 0.08
    both = N.sketch(np.unique(np.concatenate([x, y])), np.array([0]), 512)[0]
    assert (np.maximum(sx, sy) == both).all()


def test_hot_bands_lose_no_pair(spark):
    """Many texts share a long phrase, so that bands are hot; near pairs among them are found all the same."""
    import random

    rng = random.Random(5)
    phrase = [f"amt{i}" for i in range(40)]
    rows = []
    for i in range(300):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((2 * i, 1, " ".join(phrase + own)))
        rows.append((2 * i + 1, 2, " ".join(phrase + own[:-1] + ["anders"])))
    df = spark.createDataFrame(rows, "id long, doc long, text string")
    options = {"k": 1, "threshold": (8, 10), "rows": 4, "bands": 30, "stride": 4}
    found = {tuple(r) for r in N.near_duplicates(df, "id", "text", "doc", hot=5, **options).row_pairs().collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(300)}
