"""Filling containers of fixed capacity with texts (problem 6).

The plan is made on the histogram of item sizes, whose size is bounded by the
capacity and not by the data: for each size, largest first, the exact complement of
the gap is looked up among single sizes, sums of two and sums of three, and the
combination is consumed as often as the counts allow; only what has no exact
complement is filled best-fit.  Every step uses up a size, so the plan has a few
entries per size.  The items are then numbered within their size, in salted shares whose
number grows with the items, so that no size is a hot group, and find their container by
a join with the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of one share of a size; a common size is numbered in as many shares as it needs.
SHARE_ITEMS = 50_000


def _exact(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three sizes that are there and sum to the gap; the largest first."""
    if gap < len(have) and have[gap] > 0:
        return (gap,)
    there = np.flatnonzero(have[: max(0, min(gap, len(have)))])
    if not len(there):
        return None

    def two(rest: int, most: int, taken: int) -> tuple[int, int] | None:
        big = there[(there <= most) & (there < rest) & (2 * there >= rest)]
        small = rest - big
        ok = have[small] > 0
        ok &= (have[big] - (big == taken) - (small == big) > 0) & (have[small] - (small == taken) > 0)
        k = np.flatnonzero(ok)
        return (int(big[k[-1]]), int(small[k[-1]])) if len(k) else None

    pair = two(gap, gap, -1)
    if pair:
        return pair
    for a in there[there < gap][::-1]:
        a = int(a)
        if 3 * a < gap:
            break
        found = two(gap - a, a, a)
        if found:
            return (a, *found)
    return None


def plan(counts: dict[int, int], capacity: int, separator: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes, times): how often a container is filled with these sizes; every item is used exactly once.

    counts: how many items there are of each size from 1 to the capacity.
    """
    room = capacity + separator
    have = np.zeros(room + 1, np.int64)
    for size, n in counts.items():
        have[size + separator] += n
    out: list[tuple[tuple[int, ...], int]] = []
    for size in range(room, 0, -1):
        while have[size] > 0:
            filled, gap = [size], room - size
            have[size] -= 1
            while gap > 0:
                more = _exact(have, gap)
                if more is None:
                    fits = np.flatnonzero(have[: gap + 1])
                    if not len(fits):
                        break
                    more = (int(fits[-1]),)
                for m in more:
                    have[m] -= 1
                    gap -= m
                filled += more
            need: dict[int, int] = {}
            for m in filled:
                need[m] = need.get(m, 0) + 1
            again = min(int(have[m]) // n for m, n in need.items())
            for m, n in need.items():
                have[m] -= n * again
            out.append((tuple(m - separator for m in filled), 1 + again))
    return out


def _slots(name: str, made: Sequence[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """(name, size, from rank, to rank, container of the first, place): which items of a size go where."""
    rows, used, base = [], {}, 0
    for sizes, times in made:
        for place, size in enumerate(sizes):
            at = used.get(size, 0)
            rows.append((name, size, at, at + times, base, place))
            used[size] = at + times
        base += times
    return rows


def items(sizes: DataFrame, specs: DataFrame, id_col: str) -> DataFrame:
    """(container_name, id, part_no, size): whole texts, and the pieces of those that exceed the capacity.

    Texts without a token and null ids take no place.
    """
    spec = F.broadcast(specs.select("container_name", F.col("capacity_tokens").cast("bigint").alias("capacity")))
    whole = sizes.where("tokens > 0").where(F.col(id_col).isNotNull()).crossJoin(spec)
    parts = F.sequence(F.lit(0).cast("bigint"), ((F.col("tokens") - 1) / F.col("capacity")).cast("bigint"))
    cut = whole.select("container_name", id_col, "tokens", "capacity", F.explode(parts).alias("part_no"))
    return cut.select("container_name", id_col, "part_no", F.least("capacity", F.col("tokens") - F.col("part_no") * F.col("capacity")).alias("size"))


def pack(sizes: DataFrame, specs: DataFrame, id_col: str = "doc_id", share_items: int = SHARE_ITEMS) -> DataFrame:
    """(container_name, container_no, place, id, part_no, size): every item in exactly one container of each kind.

    sizes: (id, tokens).  Repeated ids are items of their own; an empty table fills nothing.
    """
    spark = sizes.sparkSession
    parts = items(sizes, specs, id_col)
    kinds = {r["container_name"]: (r["capacity_tokens"], r["separator_tokens"]) for r in specs.collect()}
    histogram: dict[str, dict[int, int]] = {name: {} for name in kinds}
    for r in parts.groupBy("container_name", "size").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[r["container_name"]][r["size"]] = r["n"]
    # a row per size and kind: bounded by the capacities
    salts = spark.createDataFrame([(name, size, -(-n // share_items)) for name, own in histogram.items() for size, n in own.items()], "container_name string, size bigint, salts bigint")
    salted = parts.join(F.broadcast(salts), ["container_name", "size"])
    all_items = salted.withColumn("salt", F.pmod(F.xxhash64(id_col, "part_no"), F.col("salts"))).drop("salts")
    counts = all_items.groupBy("container_name", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    slots = [row for name, (capacity, separator) in kinds.items() for row in _slots(name, plan(histogram[name], capacity, separator))]
    # a few rows per size and kind, whatever the data: at most some times the sum of the capacities
    table = spark.createDataFrame(slots, "container_name string, size bigint, lo bigint, hi bigint, base bigint, place int")
    before = Window.partitionBy("container_name", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("container_name", "size", "salt").orderBy(id_col, "part_no")
    ranked = all_items.withColumn("k", F.row_number().over(within) - 1).join(offsets, ["container_name", "size", "salt"])
    placed = ranked.withColumn("rank", F.col("k") + F.col("start")).join(F.broadcast(table.alias("p")), (F.col("p.container_name") == ranked["container_name"]) & (F.col("p.size") == ranked["size"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(ranked["container_name"], (F.col("base") + F.col("rank") - F.col("lo")).alias("container_no"), "place", ranked[id_col], ranked["part_no"], ranked["size"])


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(container_name, containers, items, tokens, share_used): separators count as used."""
    per = packed.groupBy("container_name", "container_no").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n"))
    per = per.join(F.broadcast(specs.select("container_name", "capacity_tokens", "separator_tokens")), "container_name")
    used = F.sum(F.col("tokens") + (F.col("n") - 1) * F.col("separator_tokens"))
    return per.groupBy("container_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("items"), F.sum("tokens").alias("tokens"), (used / F.sum("capacity_tokens")).alias("share_used"))
