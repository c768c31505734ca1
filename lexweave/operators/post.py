"""Post-processing of packed tables: cleaning, filters, deduplication, length balancing."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexweave.functions.text import ERROR, bind, randint, remove_disclosures, remove_special_tokens, strip, words
from lexweave.operators.sampling import numbered, shuffled
from lexweave.sources.io import settled

#: Tasks whose labels say where a whole text comes from.
LABELLED = ("detection", "attribution")


def drop_errors(df: DataFrame) -> DataFrame:
    """Rows whose text is not the error marker; null texts go."""
    return df.where(F.col("text") != ERROR)


def drop_empty(df: DataFrame) -> DataFrame:
    """Rows whose text is neither null nor empty."""
    return df.where(F.col("text").isNotNull() & (F.col("text") != ""))


@F.pandas_udf(StringType())
def fix_encoding(text: pd.Series) -> pd.Series:
    """Texts whose UTF-8 was read as Latin-1 or Windows-1252 are read again; then NFC, entities and line ends."""

    def fix(s: str | None) -> str | None:
        if s is None:
            return None
        for codec in ("cp1252", "latin-1"):
            if any(c in s for c in "ÃÂâð"):
                try:
                    again = s.encode(codec).decode("utf-8")
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
                s = again
        for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
            if "<" not in s or entity != "&lt;":
                s = s.replace(entity, sign)
        return unicodedata.normalize("NFC", s.replace("\r\n", "\n").replace("\r", "\n"))

    return text.map(fix)


def clean(df: DataFrame, encoding: bool = True) -> DataFrame:
    """Encoding (unless it is left as it is), strip, special tokens, disclosures; row-local, also for streams."""
    fixed = df
    if encoding:
        # only texts that the repair can change are sent to Python
        sent = fix_encoding(F.when(F.col("text").rlike(r"[^\x00-\x7f]|[&\r]"), F.col("text")))
        fixed = df.withColumn("__fixed", sent).withColumn("text", F.coalesce("__fixed", "text")).drop("__fixed")
    cleaned = bind(bind(strip(F.col("text")), remove_special_tokens), remove_disclosures)
    # as a generated column, no filter behind it can be pushed below and clean each text again
    return fixed.select(*[c for c in df.columns if c != "text"], F.explode(F.array(cleaned)).alias("text")).select(*df.columns)


def dedup_texts(df: DataFrame, key: str) -> DataFrame:
    """Of rows with one text the one with the smallest key, which may recur in other texts; null texts are one text.

    One aggregate by hash, combined before the shuffle, so that a text that recurs is one row a task.
    """
    return one_per_text(df, key)


def one_per_text(df: DataFrame, key: str, apart: bool = False) -> DataFrame:
    """dedup_texts; with ``apart`` only of texts that have one label: texts of several labels, of none, and null texts go."""
    row, order = F.struct(*df.columns), F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(*[c for c in df.columns if c not in (key, "text")]))
    told = [F.min("label").alias("a"), F.max("label").alias("b")] if apart else []
    kept = (df.where("text is not null") if apart else df).groupBy(F.sha2("text", 256).alias("__h")).agg(F.min_by(row, order).alias("r"), *told)
    return (kept.where("a = b") if apart else kept).select("r.*")


def drop_label_conflicts(df: DataFrame) -> DataFrame:
    """Rows whose text has one label; a text with only null labels has none and goes, null texts go."""
    one = df.groupBy(F.sha2("text", 256).alias("__h")).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a = b").select("__h")
    return df.withColumn("__h", F.sha2("text", 256)).join(one, "__h", "left_semi").drop("__h")


def lengths(df: DataFrame, key: str, domain: str = "domain", label: str = "label", least: int = 5, cut: int = 2, radius: float = 2.0, compat: bool = False, seed: int = 0) -> DataFrame:
    """(key, new_len): to how many words truncate() cuts each row that it keeps. Only keys and lengths are moved."""
    rows = df.where(F.col(domain).isNotNull() & F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(key), F.col(domain).alias("d"), F.col(label).cast("string").alias("l"), F.size(words(F.col("text"))).alias("n"))
    rarest = rows.groupBy("d", "l").count().groupBy("d").agg(F.min("count").alias("most"))
    with_most = shuffled(rows, ["d", "l"], key, seed, "rn").join(rarest, "d")
    ranked = numbered(with_most.where("rn <= most"), ["d", "l"], F.col("n"), ["n", key], "g")
    shortest = ranked.groupBy("d", "g").agg((F.min("n") - cut).alias("new_len")).where(F.col("new_len") >= least)
    balanced = ranked.join(shortest, ["d", "g"])
    done = balanced.select(key, "new_len")
    if not compat:
        stats = balanced.groupBy("d").agg(F.avg("new_len").alias("mu"), F.coalesce(F.stddev_samp("new_len"), F.lit(0.0)).alias("sd"))
        low = F.greatest(F.lit(least), (F.col("mu") - radius * F.col("sd")).cast("int"))
        high = F.greatest(low + 1, (F.col("mu") + radius * F.col("sd")).cast("int"))
        rest = with_most.where("rn > most").join(stats, "d").withColumn("new_len", F.least(F.col("n") - cut, randint(seed + 1, low, high - 1, F.col(key)))).where(F.col("new_len") >= least)
        done = done.unionByName(rest.select(key, "new_len"))
    return done


def truncate(df: DataFrame, key: str, domain: str = "domain", label: str = "label", least: int = 5, cut: int = 2, radius: float = 2.0, compat: bool = False, seed: int = 0) -> DataFrame:
    """(key, new_len, text): texts cut so that the labels of a domain have the same lengths.

    Per domain as many rows of each label as the rarest has, ranked by length; rows of
    one rank get their least length minus ``cut``, at least ``least`` words or they go.
    The rows beyond get a length within mean +- radius * deviation of those; with
    ``compat`` they go.  Null domains, labels and texts take no part.  The key must be unique.
    """
    return df.select(key, "text").join(lengths(df, key, domain, label, least, cut, radius, compat, seed), key).select(key, "new_len", shortened())


def shortened() -> Column:
    """The first new_len words of text."""
    return F.array_join(F.slice(words(F.col("text")), 1, F.col("new_len")), "").alias("text")


def postprocess(df: DataFrame, key: str, task: str | None = None) -> DataFrame:
    """The whole sequence of a task: clean, balance lengths, errors, empty texts, conflicting labels, repeated texts.

    Lengths are balanced for detection and attribution, where labels name the origin of
    whole texts, if there are two labels or more and ``domain``; texts of no domain are
    balanced among themselves.  Conflicting labels and repeated texts are found in one
    aggregate; positions and spans as labels are not in conflict.  Texts of mixcase come
    cleaned, as their spans count code points.  Without a task lengths stay and conflicts
    go.  The key must be unique where lengths are balanced; else it may recur.
    """
    out = df if task == "mixcase" else clean(df)
    if task in LABELLED and df.where("label is not null").select("label").distinct().limit(2).count() == 2:
        # the texts are cleaned once, and meet their lengths in one join
        out = settled(out.withColumn("__domain", F.coalesce(F.col("domain"), F.lit("\0"))))
        cut = out.drop("__domain").join(lengths(out, key, "__domain"), key)
        out = cut.select(*[shortened() if c == "text" else c for c in df.columns])
    return one_per_text(drop_empty(drop_errors(out)), key, apart=task is None or task in LABELLED)
