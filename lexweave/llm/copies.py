"""Copies hidden by formatting (problem 5): one record each, with the number of its copies.

Each normalised (field name, value) pair is hashed and the hashes of a record are
summed, so that the order of the fields cannot matter (a multiset hash).  Rows are
grouped by this fingerprint together with four more sums over the SHA-256 of the same
pairs, 224 bits of digests.  Grouping and join hash their rows and sort none.
The hashed rows are settled once, for both the grouping and the join.  Groups are
pre-aggregated before the shuffle, so a group that holds a third of all rows costs one
row per task.

The fields of rows that share a fingerprint are then compared: a table of bits of their
ids is broadcast, the rows it lets through are normalised again, and only those that
agree in every pair are copies.  Texts of rows without a fellow are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import is_empty, settle, spread, words
from lexweave.llm.cutoff import MAP_LIMIT, _mapped, _set
from lexweave.sources.io import settled

#: Bits dropped of each 64-bit hash, so that sums of up to 2 ** DROP fields cannot overflow.
DROP = 8


#: 56-bit parts that are kept of the digests.
DIGEST_PARTS = 4
#: Bits of the table for each row that shares its fingerprint; a collision costs time and no result.
MARK_SHARE = 5


def pairs(fields: Mapping[str, Column]) -> Column:
    """array<string>: the (name, value) pairs of named columns; a null value is a value of its own."""
    return F.array(*[_pair(F.lit(name.lower().strip()), value) for name, value in fields.items()])


def map_pairs(fields: Column) -> Column:
    """The same of a map<string,string> column; values are compared by their words."""
    return F.transform(F.map_entries(fields), lambda e: _pair(F.trim(F.lower(e["key"])), words(e["value"])))


def _pair(name: Column, value: Column) -> Column:
    return F.concat_ws("\x01", name, F.coalesce(value, F.lit("\x02")))


def _hashed(df: DataFrame, id_col: str, fields: Column) -> DataFrame:
    """(id, pairs, f0 ..): each row that takes part, its pairs and the commutative sums of their hashes and digests."""
    one = df.select(df[id_col].cast("bigint").alias("id"), fields.alias("pairs")).where("id is not null and pairs is not null")
    hashed = one.select("id", "pairs", F.transform("pairs", lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(7), p).alias("b"), F.sha2(p, 256).alias("d"))).alias("h"))

    def total(part: Callable[[Column], Column]) -> Column:
        summed = F.aggregate("h", F.lit(0).cast("bigint"), lambda acc, e: acc + F.shiftrightunsigned(part(e), DROP))
        return F.coalesce(summed, F.lit(0).cast("bigint"))

    sums = [total(lambda e: e["a"]), total(lambda e: e["b"])]
    sums += [total(lambda e, k=k: F.xxhash64(F.lit(k), e["d"])) for k in range(DIGEST_PARTS)]
    return hashed.select("id", "pairs", *[c.alias(f"f{k}") for k, c in enumerate(sums)])


#: The columns of a fingerprint.
FINGERPRINT = [f"f{k}" for k in range(2 + DIGEST_PARTS)]


def _groups(rows: DataFrame, *more: str) -> DataFrame:
    """(f0 .., more, first, n) of the rows that agree in all of these."""
    return rows.groupBy(*FINGERPRINT, *more).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))


def _alike(df: DataFrame, id_col: str, fields: Column, map_limit: int) -> tuple[DataFrame, DataFrame]:
    """The groups of one fingerprint, and (id, f0 .., fields) of all rows that share one, with few others."""
    df = spread(df)
    groups = _groups(keyed := settle(_hashed(df, id_col, fields).drop("pairs")))
    marked = settle(keyed.join(groups.where("n > 1").hint("shuffle_hash"), FINGERPRINT, "left_semi").select(F.xxhash64("id").alias("mark")))
    bits = max(12, (MARK_SHARE * marked.count()).bit_length())
    again = df.withColumn("mark", F.xxhash64(df[id_col].cast("bigint")))
    again = again.join(F.broadcast(_mapped(marked, "mark", bits)), _set("mark", bits), "left_semi") if bits <= map_limit else again.join(marked, "mark", "left_semi")
    rows = _hashed(again, id_col, fields)
    return groups, settled(rows.select("id", *FINGERPRINT, F.array_join(F.array_sort("pairs"), "\x03").alias("fields")))


def collapse(df: DataFrame, id_col: str, fields: Column, map_limit: int = MAP_LIMIT) -> DataFrame:
    """(id, copies): the smallest id of each group of matching rows, and how many rows it has, itself included.

    Rows with a null id or a null ``fields`` take no part; an empty table gives none.
    """
    groups, rows = _alike(df, id_col, fields, map_limit)
    compared = _groups(rows, "fields").join(groups.where("n > 1").select(*FINGERPRINT).hint("shuffle_hash"), FINGERPRINT, "left_semi")
    return groups.where("n = 1").select("first", "n").unionByName(compared.select("first", "n")).select(F.col("first").alias(id_col), F.col("n").alias("copies"))


def copies(df: DataFrame, id_col: str, fields: Column, map_limit: int = MAP_LIMIT) -> DataFrame:
    """(id_1, id_2): the smallest id of each group with each other id of it.

    The groups with more than one row are joined back on the fingerprint and the fields;
    a hot group is one row on that side, and adaptive execution splits the other side.
    A repeated id is one row of its group and no pair with itself.
    """
    _, rows = _alike(df, id_col, fields, map_limit)
    found = _groups(rows, "fields").where("n > 1").drop("n")
    return rows.join(found.hint("shuffle_hash"), [*FINGERPRINT, "fields"]).where("id <> first").select(F.col("first").alias("id_1"), F.col("id").alias("id_2")).distinct()


def text_fields(df: DataFrame, least: int = 12) -> Column:
    """Of rows with text and label; null where the label is null, the text empty or shorter than ``least`` letters and digits."""
    text, label = df["text"], df["label"].cast("string")
    enough = text.rlike(rf"(?:[\p{{L}}\p{{Nd}}][^\p{{L}}\p{{Nd}}]*+){{{least}}}")
    return F.when(label.isNotNull() & enough & ~is_empty(text), pairs({"text": words(text), "label": words(label)}))


def payload_fields(df: DataFrame, column: str = "payload") -> Column:
    """Of rows with a JSON object; null where the payload is missing or cannot be read as an object."""
    options = {"allowSingleQuotes": "false", "allowNumericLeadingZeros": "false", "mode": "PERMISSIVE"}
    whole = F.trim(F.regexp_replace(df[column], r"[\s]+$", ""))
    fields = F.from_json(F.when(whole.endswith("}") & whole.rlike(r"^\s*\{"), df[column]), "map<string,string>", options)
    return F.when(fields.isNotNull(), map_pairs(fields))
