"""Mixing sources to target weights (problem 7).

The size of a mix is cut into equal blocks of tokens, which go one by one to the
source with the highest Sainte-Lague quotient weight / (2 n + 1) that has not used up
its repeats.  The texts of a source lie in seeded hash order in shards whose number
grows with the texts; its quota, a whole number of tokens, is handed to the shards in
that order: each gives all it has, once more or not, and one, at the edge, gives a
part.  Only that shard is sorted, and what a shard leaves is never lost, so a source
misses its quota by half a text at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a mix, texts of a shard, seed of the selection.
BLOCKS, SHARD_TEXTS, SEED = 20_000, 50_000, 13


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats of each party by highest quotients; a party at its cap or without weight gets no more; ties go to the first."""
    out = [0] * len(weights)
    heap = [(-w, k) for k, w in enumerate(weights) if w > 0 and caps[k] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, k = heapq.heappop(heap)
        out[k] += 1
        seats -= 1
        if out[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * out[k] + 1), k))
    return out


def quotas(targets: Sequence[dict], stock: dict[tuple[str, int], int], blocks: int = BLOCKS) -> list[tuple]:
    """(mix, source, full, edge, rest) from targets and the tokens of each (source, shard).

    Every text of the source is taken ``full`` times, those of shards before ``edge``
    once more, and of the shard ``edge`` another ``rest`` tokens.  A mix is as large as
    its sources together.  An absent source gets nothing, a small one at most max_repeats
    times its tokens; what they leave goes to the others.
    """
    have: dict[str, dict[int, int]] = {}
    for (source, shard), n in stock.items():
        have.setdefault(source, {})[shard] = n
    rows = []
    for mix in dict.fromkeys(t["mix_name"] for t in targets):
        own = [t for t in targets if t["mix_name"] == mix and t["source"] in have]
        sizes = [sum(have[t["source"]].values()) for t in own]
        total = sum(sizes)
        if not total:
            continue
        block = max(1, total // blocks)
        caps = [n * (t["max_repeats"] or 0) // block for t, n in zip(own, sizes)]
        seats = sainte_lague([t["target_weight"] or 0 for t in own], total // block, caps)
        for t, size, n in zip(own, sizes, seats):
            full, rest = divmod(n * block, size)
            edge = -1
            for shard in sorted(have[t["source"]]):
                edge = shard
                if have[t["source"]][shard] > rest:
                    break
                rest -= have[t["source"]][shard]
            if n:
                rows.append((mix, t["source"], full, edge, rest))
    return rows


def mix(sizes: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(mix_name, source, id, tokens, repeats): how often each text is taken; never more than max_repeats.

    sizes: (id, source, tokens).  Null sources and texts without a token belong to no
    mix; repeated ids are texts of their own; an empty table gives an empty mix.
    """
    spark = sizes.sparkSession
    wanted = [r.asDict() for r in targets.collect()]
    named = sorted({t["source"] for t in wanted if t["source"] is not None})
    some = sizes.where(F.col(source_col).isin(named) & (F.col("tokens") > 0)).select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), "tokens", F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))
    # at most 2 ** 14 shards a source reach the driver, and no fewer than the largest source needs
    most = some.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    bits = min(14, max(1, (most // shard_texts).bit_length()))
    cut = some.withColumn("shard", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    stock = {(r["source"], r["shard"]): r["n"] for r in cut.groupBy("source", "shard").agg(F.sum("tokens").alias("n")).collect()}
    plan = F.broadcast(spark.createDataFrame(quotas(wanted, stock), "mix_name string, source string, full bigint, edge int, rest bigint"))
    asked = cut.join(plan, "source")
    whole = asked.where("shard <> edge").withColumn("repeats", F.col("full") + (F.col("shard") < F.col("edge")).cast("bigint"))
    order = Window.partitionBy("mix_name", "source").orderBy("h", "__id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("tokens").over(order), F.lit(0))
    part = asked.where("shard = edge").withColumn("before", before).withColumn("repeats", F.col("full") + (F.col("before") + F.col("tokens") / 2 <= F.col("rest")).cast("bigint"))
    taken = whole.unionByName(part.drop("before")).where("repeats > 0")
    return taken.select("mix_name", "source", F.col("__id").alias(id_col), "tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, texts, tokens, share): what each source of each mix was to give and gave."""
    got = mixed.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    total = got.groupBy("mix_name").agg(F.sum("tokens").alias("total"))
    asked = targets.select("mix_name", "source", F.col("target_weight").alias("target_share"))
    return asked.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left").select("mix_name", "source", "target_share", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share"))
