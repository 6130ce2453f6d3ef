import math

from hypothesis import given, settings
from hypothesis import strategies as st

from reedmill.llm.quota import controlled_rounding, fractional, plan, reached, report, sample


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(lambda c: st.lists(st.lists(st.floats(0, 20), min_size=c, max_size=c), min_size=1, max_size=7)))
def test_rounding_keeps_cells_and_margins(table):
    whole = controlled_rounding(table)
    near = lambda n, x: math.floor(x + 1e-9) <= n <= math.ceil(x - 1e-9)
    assert all(near(n, x) for w, t in zip(whole, table) for n, x in zip(w, t))
    assert all(near(sum(w), sum(t)) for w, t in zip(whole, table))
    assert all(near(sum(w), sum(t)) for w, t in zip(zip(*whole), zip(*table)))
    assert near(sum(map(sum, whole)), sum(map(sum, table)))


@given(st.lists(st.tuples(st.integers(0, 50), st.lists(st.integers(0, 20), min_size=3, max_size=3)), min_size=1, max_size=6))
def test_reached_is_what_the_pools_hold(rows):
    assert reached([d for d, _ in rows], [p for _, p in rows]) == [min(d, sum(p)) for d, p in rows]


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9), st.integers(0, 90)), min_size=1, max_size=6), st.integers(0, 200))
def test_quotas_add_up(rows, total):
    weights, least, most = [w for w, _, _ in rows], [min(a, b) for _, a, b in rows], [b for _, _, b in rows]
    got = fractional(weights, least, most, total)
    assert all(a <= q <= b for q, a, b in zip(got, least, most))
    if total <= sum(m for w, m in zip(weights, most) if w) and total >= sum(least):
        assert abs(sum(got) - max(total, sum(least))) < 1e-6 or sum(got) >= total


def test_cells_are_exact_and_the_total_is_n(spark):
    rows = [(i, f"a{i}", "Tin" if i % 10 < 7 else "Xe" if i % 10 < 9 else "Ít", ("train", "test", None)[i % 3]) for i in range(4000)]
    records = spark.createDataFrame(rows, "row_id long, article_id string, category string, split string")
    targets = spark.createDataFrame([("Tin", 40, 5), ("Xe", 10, 350), ("Ít", 50, 1)], "category string, target_pct int, min_rows int")
    table, quota, _ = plan(records, targets)
    by = {r["category"]: r for r in table}
    assert sum(quota.values()) == 1000 and {c: (r["sampled"], r["short"]) for c, r in by.items()} == {"Tin": (289, False), "Xe": (350, False), "Ít": (361, True)}
    split = {r[0]: r[3] or "" for r in rows}
    got: dict = {}
    for r in sample(records, targets).collect():
        got[r.category, split[r.row_id]] = got.get((r.category, split[r.row_id]), 0) + 1
    assert got == {k: q for k, q in quota.items() if q}


def frames(spark):
    rows = [(i, f"a{i % 90}", " THỜI  sự" if i % 2 else "Thời sự", "train" if i % 3 else None) for i in range(180)]
    rows += [(1000 + i, f"b{i}", "Xe", "test") for i in range(10)] + [(2000, None, "Xe", "test"), (2001, "c", None, "test"), (2002, "d", "Ảnh", "test")]
    records = spark.createDataFrame(rows, "row_id long, article_id string, category string, split string").selectExpr("*", "1 as count", "2 as target")
    targets = spark.createDataFrame([("Thời sự", 60, 5), ("Xe", 40, 2), ("Không", 0, 1), ("Ít", 0, 0)], "category string, target_pct int, min_rows int")
    return records, targets


def test_report_and_sample(spark):
    records, targets = frames(spark)
    got = {r.category: r for r in report(records, targets).collect()}
    assert (got["Thời sự"].pool, got["Xe"].pool, got["Không"].pool) == (90, 10, 0)
    assert [c for c, r in got.items() if r.short] == ["Không"]
    picked = sample(records, targets).collect()
    assert len({(r.category, r.article_id) for r in picked}) == len(picked)
    assert {c: sum(r.category == c for r in picked) for c in got} == {c: r.sampled for c, r in got.items()} == {"Thời sự": 15, "Xe": 10, "Không": 0, "Ít": 0}
    assert sample(records, targets).collect() == picked or sorted(sample(records, targets).collect()) == sorted(picked)
    assert sample(records.limit(0), targets).count() == 0
