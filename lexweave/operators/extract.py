"""Extractors: from a corpus (id, text, ...) to the inputs of prompts, as columns or as rows.

Positions, spans and draws are columns, never hidden state, so that packing is a join
on (id, position) and not on row order.  Texts that are null or without a unit give no
row in the extractors that make rows.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import OMITTED, clean_input, order_key, randint, sentences, uniform, words

#: Slots of the ring of examples_slotted; also the rows that are broadcast.
RING = 4096


def placeholders(template: str) -> list[str]:
    """Names in single braces; doubled braces are text."""
    return [name for _, name, _, _ in Formatter().parse(template) if name]


def fill(template: str, **inputs: Column) -> Column:
    """The template with its placeholders filled; doubled braces give single ones; a null input gives null."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name:
            parts.append(inputs[name])
    return F.concat(*parts)


def auxiliary(df: DataFrame, template: str) -> dict[str, Column]:
    """The columns that the template names and the corpus has, cleaned."""
    return {name: clean_input(F.col(name).cast("string")) for name in placeholders(template) if name in df.columns}


def dummy() -> dict[str, Column]:
    return {"dummy": F.lit("")}


def combined(*extracted: dict[str, Column]) -> dict[str, Column]:
    """Inputs of several extractors; later ones win."""
    return {k: v for d in extracted for k, v in d.items()}


def prefix(df: DataFrame, id_col: str, text_col: str, unit: str = "word", k: int | None = None, seed: int = 13) -> DataFrame:
    """prefix, suffix and k: the first k words or sentences (k given, or drawn from 1 to n - 1, at least 1) and the rest."""
    units = (words if unit == "word" else sentences)(F.col(text_col))
    drawn = F.lit(k) if k else randint(seed, 1, F.greatest(F.lit(1), F.size("__u") - 1), F.col(id_col))
    cut = df.withColumn("__u", units).withColumn("k", drawn)
    return cut.withColumn("prefix", F.array_join(F.slice("__u", 1, F.col("k")), "")).withColumn("suffix", F.array_join(F.slice("__u", F.col("k") + 1, F.greatest(F.size("__u"), F.lit(1))), "")).drop("__u")


def sentence_gaps(df: DataFrame, id_col: str, text_col: str, share: float = 0.4, max_span: int = 2, token: str = "____", seed: int = 13) -> DataFrame:
    """(id, pos, n, boundaries): a row for each chosen pair of neighbouring sentences; a fair coin each, the first ceil((n-1) share)."""
    s = df.select(F.col(id_col), sentences(F.col(text_col)).alias("s"))
    chosen = F.filter(F.sequence(F.lit(1), F.size("s") - 1), lambda i: uniform(seed, F.col(id_col), i) < 0.5)
    kept = s.where("size(s) > 1").withColumn("at", F.slice(chosen, 1, F.ceil((F.size("s") - 1) * F.lit(share)).cast("int")))
    rows = kept.select(id_col, "s", F.explode("at").alias("pos"))
    gap = F.concat(F.element_at("s", F.col("pos")), F.lit(f"\n{token}\n"), F.element_at("s", F.col("pos") + 1))
    return rows.select(id_col, "pos", randint(seed + 1, 1, max_span, F.col(id_col), F.col("pos")).cast("string").alias("n"), clean_input(gap).alias("boundaries"))


def word_gaps(df: DataFrame, id_col: str, text_col: str, share: float = 0.01, max_span: int = 20, around: tuple[int, int] = (20, 25), token: str = "____", seed: int = 13) -> DataFrame:
    """(id, pos, n, boundaries): gaps between words, scanned from the left; a chosen gap skips the words of its context."""
    w = df.select(F.col(id_col), words(F.col(text_col)).alias("w")).where("size(w) > 1")
    most = F.ceil((F.size("w") - 1) * F.lit(share)).cast("int")
    start = F.struct(F.lit(1).alias("skip"), F.array().cast("array<struct<pos:int,size:int>>").alias("got"))

    def step(acc: Column, i: Column) -> Column:
        size = randint(seed + 1, around[0], around[1], F.col(id_col), i)
        take = (acc["skip"] <= i) & (F.size(acc["got"]) < most) & (uniform(seed, F.col(id_col), i) < 0.5)
        return F.struct(
            F.when(take, i + 1 + size).otherwise(acc["skip"]).alias("skip"),
            F.when(take, F.array_append(acc["got"], F.struct(i.alias("pos"), size.alias("size")))).otherwise(acc["got"]).alias("got"),
        )

    rows = w.withColumn("g", F.explode(F.aggregate(F.sequence(F.lit(1), F.size("w") - 1), start, step)["got"])).select(id_col, "w", "g.*")
    left = F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("pos") - F.col("size")), F.least(F.col("pos"), F.col("size") + 1)), "")
    right = F.array_join(F.slice("w", F.col("pos") + 1, F.col("size")), "")
    return rows.select(id_col, "pos", randint(seed + 2, 1, max_span, F.col(id_col), F.col("pos")).cast("string").alias("n"), clean_input(F.concat(left, F.lit(f"\n{token}\n"), right)).alias("boundaries"))


def _picked(n: Column, count: Column, seed: int, key: Column) -> Column:
    """count of the positions 1 to n without replacement, in order."""
    order = F.array_sort(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(order_key(seed, F.concat_ws(":", key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(order, 1, count), lambda e: e["i"]))


def mask_sentences(df: DataFrame, id_col: str, text_col: str, share: tuple[float, float] = (0.3, 0.4), token: str = "MASK", seed: int = 13) -> DataFrame:
    """(id, masked_text, spans, positions): drawn sentences replaced by numbered masks; one sentence alone gets a mask beside it."""
    s = df.select(F.col(id_col), F.col(text_col).alias("__text"), sentences(F.col(text_col)).alias("s")).where("size(s) > 0")
    part = F.lit(share[0]) + uniform(seed, F.col(id_col)) * (share[1] - share[0])
    count = F.least(F.size("s") - 1, F.ceil(F.size("s") * part)).cast("int")
    got = s.withColumn("positions", F.when(F.size("s") > 1, _picked(F.size("s"), count, seed + 1, F.col(id_col))).otherwise(F.array(F.lit(1))))
    left = uniform(seed + 2, F.col(id_col)) < 0.5
    several = F.array_join(F.transform("s", lambda x, i: F.when(F.array_contains("positions", (i + 1).cast("int")), F.concat(F.lit(f"{token}-"), (F.array_position("positions", (i + 1).cast("int")) - 1).cast("string"), F.lit(". "))).otherwise(x)), "")
    single = F.when(left, F.concat(F.lit(f"{token}-0. "), F.element_at("s", 1))).otherwise(F.concat(F.element_at("s", 1), F.lit(f" {token}-0.")))
    return got.select(id_col, F.trim(F.when(F.size("s") > 1, several).otherwise(single)).alias("masked_text"), F.col("s").alias("spans"), "positions")


def mask_words(df: DataFrame, id_col: str, text_col: str, share: tuple[float, float] = (0.1, 0.3), spans: tuple[int, int] = (2, 5), token: str = "MASK", seed: int = 13) -> DataFrame:
    """(id, masked_text, spans, positions): spans of words on a grid wider than the longest span, so that they never meet; the tail is kept."""
    w = df.select(F.col(id_col), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    part = F.lit(share[0]) + uniform(seed, F.col(id_col)) * (share[1] - share[0])
    cells = F.greatest(F.lit(1), F.floor((F.size("w") - 1) / spans[1]).cast("int"))
    count = F.least(cells, F.ceil(F.size("w") * part / spans[1]).cast("int"))
    got = w.withColumn("cells", _picked(cells, count, seed + 1, F.col(id_col)))
    size = lambda c: randint(seed + 2, spans[0], spans[1], F.col(id_col), c)
    cell = lambda i: (F.floor(i / spans[1]) + 1).cast("int")

    def put(x: Column, i: Column) -> Column:
        inside = F.array_contains("cells", cell(i)) & (i % spans[1] < size(cell(i)))
        first = inside & (i % spans[1] == 0)
        name = F.concat(F.lit(f"{token}-"), (F.array_position("cells", cell(i)) - 1).cast("string"), F.lit(" "))
        return F.when(first, name).when(inside, F.lit("")).otherwise(x)

    def piece(x: Column, i: Column) -> Column:
        inside = F.array_contains("cells", cell(i)) & (i % spans[1] < size(cell(i)))
        return F.struct(x.alias("x"), inside.alias("inside"), (i % spans[1] == 0).alias("first"))

    kept = F.filter(F.transform("w", piece), lambda e: ~e["inside"] | e["first"])
    positions = F.filter(F.transform(kept, lambda e, i: F.when(e["inside"], (i + 1).cast("int"))), lambda p: p.isNotNull())
    return got.select(id_col, F.trim(F.array_join(F.transform("w", put), "")).alias("masked_text"), F.transform(kept, lambda e: e["x"]).alias("spans"), positions.alias("positions"))


def sentence_rewrites(df: DataFrame, id_col: str, text_col: str, share: tuple[float, float] = (0.3, 0.4), seed: int = 13) -> DataFrame:
    """(id, pos, sentence): a row for each drawn sentence, 1 to ceil(share n) of them; documents without sentences are skipped."""
    s = df.select(F.col(id_col), sentences(F.col(text_col)).alias("s")).where("size(s) > 0")
    part = F.lit(share[0]) + uniform(seed, F.col(id_col)) * (share[1] - share[0])
    count = randint(seed + 1, 1, F.ceil(part * F.size("s")).cast("int"), F.col(id_col))
    rows = s.select(id_col, "s", F.explode(_picked(F.size("s"), count, seed + 2, F.col(id_col))).alias("pos"))
    return rows.select(id_col, "pos", clean_input(F.element_at("s", F.col("pos"))).alias("sentence"))


def examples_fixed(df: DataFrame, id_col: str, text_col: str, k: int = 2, seed: int = 13) -> DataFrame:
    """The same k seeded texts beside every row, as example_1 .. example_k (k rows are broadcast)."""
    few = df.where(F.col(text_col).isNotNull()).orderBy(order_key(seed, F.col(id_col)), id_col).limit(k).select(F.col(id_col).alias("__i"), clean_input(F.col(text_col)).alias("__t"))
    one = few.agg(F.array_sort(F.collect_list(F.struct(order_key(seed, F.col("__i")).alias("h"), "__t"))).alias("e"))
    joined = df.select(id_col).crossJoin(F.broadcast(one))
    return joined.select(id_col, *[F.get(F.col("e"), F.lit(i)).getField("__t").alias(f"example_{i + 1}") for i in range(k)])


def numbered(df: DataFrame, id_col: str, text_col: str, seed: int = 13) -> DataFrame:
    """(rank, example_id): all texts in seeded order, from 0; counts per bucket and offsets, so no task sees more than a bucket."""
    h = order_key(seed, F.col(id_col))
    held = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("example_id"), h.alias("h"), F.substring(h, 1, 3).alias("bucket"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", before.alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("h", "example_id")) - 1
    return held.join(F.broadcast(offsets), "bucket").select(rank.alias("rank"), "example_id")


def examples_random(df: DataFrame, id_col: str, text_col: str, k: int = 2, seed: int = 13) -> DataFrame:
    """(id, example_no, example_id): k different texts per row, each drawn from all texts, by an equi-join on their numbers.

    The i-th draw is from the texts not drawn yet: it is shifted past the earlier ones.
    A table with fewer than k texts gives each row all of them.
    """
    total = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).agg(F.count(F.lit(1)).alias("__total"))
    rows = df.select(id_col).crossJoin(F.broadcast(total)).withColumn("__drawn", F.array().cast("array<bigint>"))
    for i in range(k):
        left = F.col("__total") - i
        new = F.floor(uniform(seed + 1, F.col(id_col), F.lit(i + 1)) * left)
        shifted = F.aggregate(F.array_sort("__drawn"), new, lambda at, taken: F.when(at >= taken, at + 1).otherwise(at))
        step = F.when(left > 0, F.array_append("__drawn", shifted)).otherwise(F.col("__drawn"))
        rows = rows.withColumn("__drawn", step)
    wants = rows.select(id_col, F.posexplode("__drawn").alias("example_no", "rank")).withColumn("example_no", F.col("example_no") + 1)
    return wants.join(numbered(df, id_col, text_col, seed), "rank").select(id_col, "example_no", "example_id")


def examples_slotted(df: DataFrame, id_col: str, text_col: str, k: int = 2, seed: int = 13) -> DataFrame:
    """(id, example_no, example_id): k draws per row, with repeats, from a ring of RING slots, each with the smallest id of its hash.

    A slot without a text takes the next one's, so every row gets k examples if there is
    any text.  At most RING texts can be drawn; examples_random draws from all.
    """
    slot = F.conv(F.substring(order_key(seed, F.col(id_col)), 1, 3), 16, 10).cast("int")
    held = df.where(F.col(text_col).isNotNull()).select(slot.alias("slot"), F.col(id_col).alias("x")).groupBy("slot").agg(F.min("x").alias("x"))
    ring = df.sparkSession.range(RING).select(F.col("id").cast("int").alias("slot")).join(held, "slot", "left")
    ahead = Window.orderBy("slot").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = ring.select("slot", F.coalesce(F.first("x", ignorenulls=True).over(ahead), F.first("x", ignorenulls=True).over(whole)).alias("example_id"))
    wants = df.select(id_col, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("example_no"))
    wants = wants.withColumn("slot", F.floor(uniform(seed + 1, F.col(id_col), F.col("example_no")) * RING).cast("int"))
    return wants.join(F.broadcast(full), "slot").where("example_id is not null").select(id_col, "example_no", "example_id")


def omitted(value: Column) -> Column:
    return F.when((value == "") | value.isNull(), F.lit(OMITTED)).otherwise(value)
