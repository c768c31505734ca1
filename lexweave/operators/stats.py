"""Counts, length limits and quality metrics of packed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import ERROR, bare_words, unique_share


def domain_model_counts(df: DataFrame) -> DataFrame:
    """(domain, model, n) with totals, marked by all_domains and all_models; texts with an error are left out."""
    kept = df.where(~F.col("text").contains(ERROR))
    return kept.cube("domain", "model").agg(F.count(F.lit(1)).alias("n"), F.grouping("domain").cast("int").alias("all_domains"), F.grouping("model").cast("int").alias("all_models"))


def errors_per_model(df: DataFrame) -> DataFrame:
    """(model, texts, errors) and a total row, marked by all_models."""
    bad = F.coalesce(F.col("text").contains(ERROR), F.lit(False))
    return df.rollup("model").agg(F.count_if(~bad).alias("texts"), F.count_if(bad).alias("errors"), F.grouping("model").cast("int").alias("all_models"))


def count_errors(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("text") == ERROR).alias("errors"), F.count(F.lit(1)).alias("texts"))


def length_limits(df: DataFrame, size: Column, by: list[str], centre: str = "mean", least: int = 10, most: int = 512) -> DataFrame:
    """(by, min_tokens, max_tokens): centre +- two population deviations of the clipped sizes, within least and most."""
    sizes = df.select(*by, F.least(size, F.lit(most)).alias("n"))
    mid, sd = (F.avg("n") if centre == "mean" else F.median("n")), F.stddev_pop("n")
    return sizes.groupBy(*by).agg(F.greatest(F.lit(float(least)), mid - 2 * sd).cast("int").alias("min_tokens"), F.least(F.lit(float(most)), mid + 2 * sd).cast("int").alias("max_tokens"))


def repetition(df: DataFrame, text: Column, ns: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """rep_n = 100 (1 - distinct / all) for each n, and diversity, the product of the shares of distinct n-grams."""
    shared = df.withColumn("__w", bare_words(text))
    for n in ns:
        shared = shared.withColumn(f"__s{n}", unique_share(F.col("__w"), n))
    div = F.lit(1.0)
    for n in ns:
        div = div * F.col(f"__s{n}")
    return shared.select(*df.columns, *[F.round(100 * (1 - F.col(f"__s{n}")), 6).alias(f"rep_{n}") for n in ns], F.round(div, 6).alias("diversity"))


def mean_by_label(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Means per label and over all (label null and all_labels 1)."""
    return df.rollup(label).agg(*[F.round(F.avg(c), 4).alias(c) for c in columns], F.grouping(label).cast("int").alias("all_labels"))


def regression_report(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    d = df.select(truth.cast("double").alias("t"), guess.cast("double").alias("p")).where("t is not null and p is not null")
    e = F.col("t") - F.col("p")
    var = F.var_pop("t")
    return d.agg(F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.median(F.abs(e)), 6).alias("median_ae"), F.round(F.avg(e * e), 6).alias("mse"), F.round(F.max(F.abs(e)), 6).alias("max_error"), F.round(1 - F.avg(e * e) / var, 6).alias("r2"), F.round(1 - F.var_pop(e) / var, 6).alias("explained_variance"), F.count(F.lit(1)).alias("support"))


def classification_report(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(label, precision, recall, f1, support) from the confusion counts; a division by zero gives 0."""
    pairs = df.select(truth.alias("t"), guess.alias("p")).where("t is not null and p is not null").groupBy("t", "p").count()
    long = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("is_t"), F.lit(0).alias("is_p")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_t"), F.lit(1).alias("is_p")))).alias("x"), "count", (F.col("t") == F.col("p")).alias("ok"))
    sums = long.groupBy("x.label").agg(F.sum(F.col("x.is_t") * F.col("count")).alias("support"), F.sum(F.col("x.is_p") * F.col("count")).alias("said"), F.sum(F.when(F.col("ok"), F.col("x.is_t") * F.col("count")).otherwise(0)).alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    return sums.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), "support")


def classification_summary(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(average, precision, recall, f1, support): over all rows (accuracy, in all three), the mean of the labels (macro), and by their support (weighted)."""
    each = classification_report(df, truth, guess)
    hit = F.sum(F.col("recall") * F.col("support"))
    scores = ["precision", "recall", "f1"]
    all_rows = each.agg((hit / F.sum("support")).alias("accuracy"), F.sum("support").alias("support"), *[F.avg(c).alias(f"m_{c}") for c in scores], *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in scores])
    kinds = {"accuracy": ["accuracy"] * 3, "macro": [f"m_{c}" for c in scores], "weighted": [f"w_{c}" for c in scores]}
    rows = F.array(*[F.struct(F.lit(k).alias("average"), *[F.round(F.col(c), 5).alias(n) for c, n in zip(cs, scores)], F.col("support")) for k, cs in kinds.items()])
    return all_rows.select(F.explode(rows).alias("r")).select("r.*").where("support > 0")


def over_folds(reports: DataFrame, by: list[str], scores: list[str], fold: str = "fold") -> DataFrame:
    """(by, <score>_mean, <score>_std, folds): mean and sample deviation of the scores of all folds; one fold deviates by 0."""
    cols = [c for s in scores for c in (F.round(F.avg(s), 5).alias(f"{s}_mean"), F.round(F.coalesce(F.stddev_samp(s), F.lit(0.0)), 5).alias(f"{s}_std"))]
    return reports.groupBy(*by).agg(*cols, F.count_distinct(fold).alias("folds"))


def boundary_tags(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, token_no, tag): 0 for a token that ends within the human prefix, 1 beyond."""
    return _tokens(df, id_col, text_col, [label_col]).where(F.col(label_col).isNotNull()).select(id_col, "token_no", F.when(F.col("tok_end") <= F.col(label_col), 0).otherwise(1).alias("tag"))


def span_tags(df: DataFrame, id_col: str, text_col: str, spans_col: str) -> DataFrame:
    """(id, token_no, tag): the label of the first span that holds the start of the token; none outside all spans."""
    t = _tokens(df, id_col, text_col, [spans_col])
    inside = F.filter(spans_col, lambda s: (s["span_start"] <= F.col("tok_start")) & (F.col("tok_start") < s["span_end"]))
    first = F.get(F.array_sort(F.transform(inside, lambda s: F.struct(s["span_start"].alias("a"), s["span_label"].alias("l")))), F.lit(0))["l"]
    return t.where(F.col(spans_col).isNotNull()).select(id_col, "token_no", first.alias("tag"))


def _tokens(df: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """A row per word with its place; the running offset is a sum over the words of one text."""
    parts = F.regexp_extract_all(F.col(text_col), F.lit(r"[^ \t\n\r\f]+|[ \t\n\r\f]+"), 0)
    rows = df.select(F.col(id_col), *others, F.posexplode(parts)).withColumn("len", F.length("col"))
    order = Window.partitionBy(id_col).orderBy("pos")
    rows = rows.withColumn("tok_end", F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("tok_start", F.col("tok_end") - F.col("len"))
    kept = rows.where(~F.col("col").rlike(r"^[ \t\n\r\f]"))
    return kept.withColumn("token_no", F.row_number().over(order))
