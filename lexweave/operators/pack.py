"""Packers: from human texts and generations to labelled tables, and the algebra of character spans.

Spans are half-open and count code points.  A text built from pieces (id, pos, sub,
label, piece) gets its spans by a running sum of lengths and neighbouring pieces of
one label are merged (gaps and islands); both are one window over the pieces of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import ERROR, NO_EXTRACTOR, NO_PROMPT, sentences, strip


def detection(df: DataFrame, id_col: str, prompt: Column, human: Column, generated: Column, model: str, extractor: str) -> DataFrame:
    """Human and generated rows with the label human or generated."""
    h = df.select(F.col(id_col), F.lit(NO_PROMPT).alias("prompt"), human.alias("text"), F.lit("human").alias("label"), F.lit("human").alias("model"), F.lit(NO_EXTRACTOR).alias("extractor"))
    g = df.select(F.col(id_col), prompt.alias("prompt"), generated.alias("text"), F.lit("generated").alias("label"), F.lit(model).alias("model"), F.lit(extractor).alias("extractor"))
    return h.unionByName(g)


def attribution(df: DataFrame, id_col: str, prompt: Column, generated: Column, model: str, extractor: str) -> DataFrame:
    """Generated rows, labelled with the model."""
    return df.select(F.col(id_col), prompt.alias("prompt"), generated.alias("text"), F.lit(model).alias("label"), F.lit(model).alias("model"), F.lit(extractor).alias("extractor"))


def boundary(df: DataFrame, id_col: str, prompt: Column, human: Column, generated: Column, model: str, extractor: str) -> DataFrame:
    """Human prefix, a space, generated rest; the label is the length of the prefix."""
    return df.select(F.col(id_col), prompt.alias("prompt"), F.concat(strip(human), F.lit(" "), strip(generated)).alias("text"), F.length(strip(human)).cast("bigint").alias("label"), F.lit(model).alias("model"), F.lit(extractor).alias("extractor"))


def piece_spans(pieces: DataFrame, id_col: str) -> DataFrame:
    """(id, span_no, span_start, span_end, span_label) of pieces(id, pos, sub, label, piece); empty pieces make no span."""
    order = Window.partitionBy(id_col).orderBy("pos", "sub")
    at = pieces.where(F.length("piece") > 0).withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    new = F.coalesce((F.lag("label").over(order) != F.col("label")).cast("int"), F.lit(1))
    islands = at.withColumn("new", new).withColumn("span_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(id_col, "span_no").agg(F.min(F.col("end") - F.length("piece")).cast("int").alias("span_start"), F.max("end").cast("int").alias("span_end"), F.first("label").alias("span_label"))


def join_pieces(pieces: DataFrame, id_col: str) -> DataFrame:
    """(id, text) of the same pieces."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "sub", "piece")))
    return pieces.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))


def gap_pieces(df: DataFrame, id_col: str, text_col: str, gaps: DataFrame, units: Callable[[Column], Column] = sentences) -> DataFrame:
    """Sentences or words with the generation of each gap (id, pos, generation) behind the one before it."""
    human = df.select(F.col(id_col), F.posexplode(units(F.col(text_col)))).select(id_col, (F.col("pos") + 1).alias("pos"), F.lit(0).alias("sub"), F.lit("human").alias("label"), F.col("col").alias("piece"))
    made = gaps.select(id_col, "pos", F.lit(1).alias("sub"), F.lit("generated").alias("label"), F.concat("generation", F.lit(" ")).alias("piece"))
    return human.unionByName(made)


def rewrite_pieces(df: DataFrame, id_col: str, text_col: str, rewrites: DataFrame) -> DataFrame:
    """Sentences, those with a rewrite (id, pos, generation) replaced by it and a space."""
    human = df.select(F.col(id_col), F.posexplode(sentences(F.col(text_col)))).select(id_col, (F.col("pos") + 1).alias("pos"), F.col("col").alias("old"))
    both = human.join(rewrites.select(id_col, "pos", "generation"), [id_col, "pos"], "left")
    return both.select(id_col, "pos", F.lit(0).alias("sub"), F.when(F.col("generation").isNull(), "human").otherwise("generated").alias("label"), F.coalesce(F.concat("generation", F.lit(" ")), "old").alias("piece"))


def mask_pieces(masked: DataFrame, id_col: str, completion: Column) -> DataFrame:
    """Sentences, those at the masked positions replaced by the JSON completion {"MASK-i": text}.

    masked: (id, spans, positions).  The object is cut from the first to the last brace;
    one that cannot be read or lacks a mask makes the whole text an error.
    """
    found = F.from_json(F.regexp_extract(completion, r"(?s)\{.*\}", 0), "map<string,string>")
    names = F.transform(F.sequence(F.lit(1), F.size("positions")), lambda i: F.concat(F.lit("MASK-"), (i - 1).cast("string")))
    known = masked.withColumn("__c", found).withColumn("__n", names)
    good = F.coalesce(F.size(F.array_except("__n", F.map_keys("__c"))) == 0, F.lit(False))
    rows = known.withColumn("__good", good).select("*", F.posexplode(F.when(F.col("__good"), F.col("spans")).otherwise(F.array(F.lit(ERROR)))))
    place = F.array_position("positions", (F.col("pos") + 1).cast("int"))
    masked_here = F.col("__good") & (place > 0)
    text = F.element_at("__c", F.concat(F.lit("MASK-"), (place - 1).cast("string")))
    return rows.select(id_col, (F.col("pos") + 1).alias("pos"), F.lit(0).alias("sub"), F.when(masked_here | ~F.col("__good"), "generated").otherwise("human").alias("label"), F.when(masked_here, F.concat(text, F.lit(" "))).otherwise(F.col("col")).alias("piece"))


def human_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One human span over each text; empty texts have none."""
    return df.where(F.length(text_col) > 0).select(F.col(id_col), F.lit(0).alias("span_start"), F.length(text_col).cast("int").alias("span_end"), F.lit("human").alias("span_label"))


def complement(spans: Column, length: Column, label: str = "human") -> Column:
    """Sorted, disjoint spans with the gaps between them, before and behind filled by spans of the label."""
    end = lambda s: s["end"]
    kind = "array<struct<start:int,end:int,label:string>>"
    span = lambda a, b, name: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), name.alias("label"))
    acc = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] > a["at"], F.array(span(a["at"], s["start"], F.lit(label)))).otherwise(F.array().cast(kind))
        return F.struct(end(s).cast("int").alias("at"), F.concat(a["out"], gap, F.array(span(s["start"], s["end"], s["label"]))).alias("out"))

    done = F.aggregate(F.array_sort(spans), acc, add, lambda a: F.concat(a["out"], F.when(a["at"] < length, F.array(span(a["at"], length, F.lit(label)))).otherwise(F.array().cast(kind))))
    return done
