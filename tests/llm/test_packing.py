import numpy as np
from hypothesis import given, settings, strategies as st

from minuteworks.llm import mixing as M, packing as P


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2048), max_size=200))
def test_containers_hold_their_items(lengths):
    order = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    at, offset, size = P.best_fit(order, P.SIZES)
    used = {}
    for n, c, o, s in zip(order, at, offset, size, strict=True):
        assert o == used.get(c, 0) and s in P.SIZES
        used[c] = o + n
    assert all(used[c] <= s for c, s in zip(at, size, strict=True))
    assert sum(dict(zip(at.tolist(), size.tolist(), strict=True)).values()) <= 2 * sum(lengths) + 2048


def test_pack_rows(spark):
    rows = [(1, "wort " * 5000, "a"), (2, "kurz", "a"), (3, None, "a"), (4, "", "a"), (2, "kurz", "a")] + [(10 + i, "ein satz mit worten " * (i % 60 + 1), "b") for i in range(300)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string, container string")).collect()
    by = {}
    for r in out:
        by.setdefault(r["container"], []).append(r)
    assert sum(r["id"] == 2 for r in out) == 2 and {r["id"] for r in out} == {r[0] for r in rows}
    for parts in by.values():
        parts.sort(key=lambda r: (r["position"], r["n_tokens"]))
        assert sum(r["n_tokens"] for r in parts) <= parts[0]["container_size"] <= 2048
    long = sorted((r for r in out if r["id"] == 1), key=lambda r: r["piece"])
    assert [r["start_token"] for r in long] == [2048 * i for i in range(len(long))] and len(long) == long[0]["n_pieces"] > 1
    assert all(r["n_pieces"] == 1 for r in out if r["id"] != 1)
    full = sum(p[0]["container_size"] for p in by.values())
    assert sum(r["n_tokens"] for r in out) > 0.95 * full
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shares_are_filled_in_proportion():
    got = M.fill_shares({"a": 100, "b": 10, "c": 890}, {"a": (0.4, 1), "b": (0.2, 2), "c": (0.4, 1)}, 1000)
    assert got["a"] == 0.1 and got["b"] == 0.02 and abs(got["c"] - 0.88) < 1e-9
    assert sum(M.fill_shares({"a": 10}, {"a": (1.0, 3)}, 100).values()) == 0.3
    assert M.fill_shares({}, {}, 0) == {}


def test_mixture(spark):
    rows = [(i, f"text nummer {i} mit einigen worten im rat " * 6, "big" if i % 5 else "small", "x") for i in range(600)] + [(9000, None, "small", "x"), (9001, "ohne quelle", None, "x"), (9002, "fremd", "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 4), ("tiny", 0.1, 2), (None, 0.3, 1), ("bad", -1.0, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mix(docs, targets, block_tokens=400)
    report = {r["source"]: r for r in mixed.report.collect()}
    assert not report["tiny"]["reachable"] and report["small"]["reachable"]
    uses = mixed.schedule.groupBy("id", "source").count().collect()
    assert max(r["count"] for r in uses if r["source"] == "small") <= 4 and max(r["count"] for r in uses if r["source"] == "big") == 1
    total = sum(r["used_tokens"] for r in report.values())
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    wanted = sum(r["available_tokens"] for r in report.values())
    assert abs(total - wanted) < 0.1 * wanted
    assert abs(report["small"]["actual_share"] - 0.5) < 0.06
    slots = sorted({(r["slot"], r["source"]) for r in mixed.schedule.select("slot", "source").collect()})
    half = [s for _, s in slots[: len(slots) // 2]]
    assert abs(half.count("small") / len(half) - 0.5) < 0.1


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    mixed = M.mix(docs, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert mixed.schedule.count() == 0 and [r["reachable"] for r in mixed.report.collect()] == [True]
