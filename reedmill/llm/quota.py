"""Problem 2: a sample whose share of each category follows given targets.

Method: controlled rounding.  A maximum flow through the two-way table (category by stratum) tells how much of each
category's demand, its target or least number, the pools can give: a category that gets less cannot be met.  The
quotas follow the targets within the pools and least numbers and add up to the size of the sample; what categories
cannot give is spread over the others in proportion to their targets.  The fractional table is made integer by a
second flow that keeps every cell, both margins and the total within one of the fractional values; then each cell
takes exactly its quota of the records with the smallest random keys.

A label belongs to a target if both are the same apart from case, Unicode form and blanks.  Units are distinct
``article_id`` of a category; records with a null id, a null label or a label outside the targets do not count.
An empty input gives pools and quotas of 0.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reedmill.llm.unify import one_form

BUCKETS = 4096
#: The sample has this part of all pools.
PART = 4
#: Largest number of targets and of cells that the driver rounds.
MAX_CELLS = 100_000


def label_key(label: Column) -> Column:
    """A label without case, Unicode form and blanks at its ends or repeated."""
    return F.trim(F.regexp_replace(F.lower(one_form(label)), r"\s+", " "))


def max_flow(nodes: int, arcs: list[tuple[int, int, int]], s: int, t: int) -> list[int]:
    """The flow on each arc (from, to, capacity) of a maximum flow from s to t, by shortest augmenting paths."""
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(nodes)]
    for a, b, c in arcs:  # each arc is followed by its reverse
        for x, y, r in ((a, b, c), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
    while True:
        via = {s: -1}
        queue = deque([s])
        while queue and t not in via:
            v = queue.popleft()
            for k in out[v]:
                if room[k] and to[k] not in via:
                    via[to[k]] = k
                    queue.append(to[k])
        if t not in via:
            return room[1::2]
        path, v = [], t
        while v != s:
            path.append(via[v])
            v = to[via[v] ^ 1]
        step = min(room[k] for k in path)
        for k in path:
            room[k] -= step
            room[k ^ 1] += step


def controlled_rounding(table: list[list[float]]) -> list[list[int]]:
    """An integer table in which each cell, row sum, column sum and the total is the floor or ceiling of its value."""
    rows, cols = len(table), len(table[0]) if table else 0
    s, t, S, T = range(rows + cols, rows + cols + 4)
    near = lambda x: max(1e-9, 4e-15 * x)  # noqa: E731  sums of large quotas are off by more
    low_high = lambda x: (math.floor(x + near(x)), math.ceil(x - near(x)))
    bounds = [(i, rows + j, *low_high(table[i][j])) for i in range(rows) for j in range(cols)]
    bounds += [(s, i, *low_high(sum(table[i]))) for i in range(rows)]
    bounds += [(rows + j, t, *low_high(sum(r[j] for r in table))) for j in range(cols)]
    bounds.append((t, s, *low_high(sum(map(sum, table)))))
    # the lower bounds become demands and supplies of the nodes
    excess = [0] * (rows + cols + 4)
    for a, b, lo, _ in bounds:
        excess[b] += lo
        excess[a] -= lo
    arcs = [(a, b, hi - lo) for a, b, lo, hi in bounds] + [(S, v, e) if e > 0 else (v, T, -e) for v, e in enumerate(excess) if e]
    flow = [lo + f for f, (_, _, lo, _) in zip(max_flow(rows + cols + 4, arcs, S, T), bounds, strict=False)]
    return [flow[i * cols : (i + 1) * cols] for i in range(rows)]


def reached(demand: list[int], pools: list[list[int]]) -> list[int]:
    """How much of each row's demand the cells of its row can give: a maximum flow through the two-way table."""
    rows, cols = len(pools), len(pools[0]) if pools else 0
    s, t = rows + cols, rows + cols + 1
    arcs = [(s, i, demand[i]) for i in range(rows)] + [(i, rows + j, pools[i][j]) for i in range(rows) for j in range(cols)] + [(rows + j, t, sum(demand)) for j in range(cols)]
    return max_flow(rows + cols + 2, arcs, s, t)[:rows]


def fractional(weights: list[float], least: list[int], most: list[int], total: int) -> list[float]:
    """Quotas in proportion to the weights, but within their bounds, that add up to the total where the bounds allow it."""
    at = lambda x: [min(m, max(k, x * w)) for w, k, m in zip(weights, least, most, strict=True)]
    total = min(max(total, sum(least)), sum(most))
    lo, hi = 0.0, 1.0
    while sum(at(hi)) < total and hi < 1e18:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) < total else (lo, mid)
    return at(hi)


def units(records: DataFrame, targets: DataFrame, stratum: str = "split") -> DataFrame:
    """One row per target category and article: category, stratum, article_id and the smallest row_id."""
    named = targets.select(F.col("category").alias("target"), label_key(F.col("category")).alias("key"))
    rows = records.where("article_id is not null and category is not null")
    rows = rows.select("row_id", "article_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), label_key(F.col("category")).alias("key"))
    once = rows.groupBy("key", "article_id").agg(F.min(F.struct("row_id", "stratum")).alias("first"))
    return once.join(named, "key").select(F.col("target").alias("category"), "article_id", "first.*")


def plan(records: DataFrame, targets: DataFrame, stratum: str = "split") -> tuple[list[dict], dict[tuple[str, str], int], DataFrame]:
    """The report rows, the integer quota of each cell, and the units."""
    goal = targets.select("category", "target_pct", "min_rows").limit(MAX_CELLS + 1).collect()
    unit = units(records, targets, stratum)
    cells = unit.groupBy("category", "stratum").count().limit(MAX_CELLS + 1).collect()
    if max(len(goal), len(cells)) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} targets or cells")
    pool = {(c, s): n for c, s, n in cells}
    of = {g.category: sum(n for (c, _), n in pool.items() if c == g.category) for g in goal}
    n = sum(of.values()) // PART
    strata = sorted({s for _, s in pool})
    pools = [[pool.get((g.category, s), 0) for s in strata] for g in goal]
    # what the targets and the least numbers ask for, and how much of it the pools can give
    demand = [max(g.min_rows, -(-g.target_pct * n // 100)) for g in goal]
    given = reached(demand, pools) if strata else [0] * len(goal)
    sizes = [of[g.category] for g in goal]
    wanted = fractional([g.target_pct for g in goal], [min(g.min_rows, x) for g, x in zip(goal, sizes, strict=True)], sizes, n)
    table = [[w * x / max(size, 1) for x in row] for w, row, size in zip(wanted, pools, sizes, strict=True)]
    whole = controlled_rounding(table) if strata else [[] for _ in goal]
    quota = {(g.category, s): q for g, row in zip(goal, whole, strict=True) for s, q in zip(strata, row, strict=True)}
    drawn = max(sum(map(sum, whole)), 1)
    report = [
        {"category": g.category, "target_pct": g.target_pct, "min_rows": g.min_rows, "pool": of[g.category], "wanted": d, "sampled": sum(row), "actual_pct": sum(row) * 100 / drawn, "short": x < d}
        for g, row, d, x in zip(goal, whole, demand, given, strict=True)
    ]
    return report, quota, unit


REPORT = "category string, target_pct int, min_rows int, pool long, wanted long, sampled long, actual_pct double, short boolean"


def report(records: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: its pool, how many are wanted and sampled, the actual share, and whether the target cannot be met."""
    rows, _, _ = plan(records, targets)
    return records.sparkSession.createDataFrame([tuple(r.values()) for r in rows], REPORT)


def sample(records: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """The sampled articles (category, article_id, row_id): exactly the quota of each cell, by smallest random keys.

    The cut of a cell is found from counts of key buckets; only its boundary bucket is ranked, so no task gets a
    whole cell.
    """
    _, quota, unit = plan(records, targets)
    spark = records.sparkSession
    key = F.xxhash64("category", "article_id", F.lit(seed))
    keyed = unit.withColumn("k", key).withColumn("bucket", F.shiftrightunsigned("k", 52).cast("int"))
    cells = spark.createDataFrame([(c, s, q) for (c, s), q in quota.items() if q] or [("", "", 0)], "category string, stratum string, quota long")
    counts = keyed.groupBy("category", "stratum", "bucket").count()
    upto = Window.partitionBy("category", "stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.join(F.broadcast(cells), ["category", "stratum"]).withColumn("below", F.coalesce(F.sum("count").over(upto), F.lit(0))).where("below < quota")
    # one row per cell: the last bucket that is needed, and how many of its records
    edge_of = below.groupBy("category", "stratum").agg(F.max(F.struct("bucket", (F.col("quota") - F.col("below")).alias("left"))).alias("x")).select("category", "stratum", F.col("x.bucket").alias("edge"), "x.left")
    chosen = keyed.join(F.broadcast(edge_of), ["category", "stratum"]).where("bucket <= edge")
    rank = F.row_number().over(Window.partitionBy("category", "stratum").orderBy("k", "article_id"))
    out = ["category", "article_id", "row_id"]
    edge = chosen.where("bucket = edge").withColumn("rank", rank).where("rank <= left")
    return chosen.where("bucket < edge").select(out).unionByName(edge.select(out))
