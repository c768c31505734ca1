"""The queries of the training-data problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import copies as _copies
from lexweave.llm.cutoff import share_cut, truncated
from lexweave.llm.crf import Crf
from lexweave.llm.language import label_names, segments, train
from lexweave.llm.mixing import mix, shares
from lexweave.llm.packing import fill, pack
from lexweave.llm.pairs import defects
from lexweave.llm.reading import levels, sound_english
from lexweave.llm.tokens import token_sizes
from lexweave.llm.units import sentence_units


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, records = _read(spark, sf_dir, "generated_dataset"), _read(spark, sf_dir, "raw_record")
    a = _copies.copies(rows, "row_id", _copies.text_fields(rows)).select(F.lit("generated_dataset").alias("tbl"), "id_1", "id_2")
    b = _copies.copies(records, "record_id", _copies.payload_fields(records)).select(F.lit("raw_record").alias("tbl"), "id_1", "id_2")
    return a.unionByName(b)


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "generated_dataset")
    return _copies.collapse(rows, "row_id", _copies.text_fields(rows))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "generated_dataset")
    both = docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("record_key"), "text", F.col("lang").alias("label"))
    both = both.unionByName(rows.select(F.lit("generated_dataset").alias("tbl"), F.col("row_id").alias("record_key"), "text", F.col("language").alias("label")))
    return segments(both, docs, _read(spark, sf_dir, "lang_code"), ["tbl", "record_key"], "text", "label")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).where("segs > 1 or not named").select("tbl", "record_key", "seg_no", "lang")


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("tbl", "record_key", "seg_no", "start_pos", "end_pos", "lang", "confidence")


def _model(spark: SparkSession, sf_dir: str) -> Crf:
    return train(_read(spark, sf_dir, "documents"), label_names(_read(spark, sf_dir, "lang_code").collect()))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "generated_dataset")
    return sound_english(rows, _read(spark, sf_dir, "reading_sample"), _model(spark, sf_dir))


def p2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(_read(spark, sf_dir, "generated_dataset"), _read(spark, sf_dir, "reading_sample"), _model(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "generated_dataset")
    return defects(rows, _model(spark, sf_dir), truncated(rows))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(_read(spark, sf_dir, "generated_dataset"))


def p4_share_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_cut(_read(spark, sf_dir, "generated_dataset"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_sizes(_read(spark, sf_dir, "documents"), "doc_id")
    return pack(sizes, _read(spark, sf_dir, "container_spec"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(p6_containers(spark, sf_dir), _read(spark, sf_dir, "container_spec"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_sizes(_read(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mix(sizes, _read(spark, sf_dir, "mix_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(p7_mix(spark, sf_dir), _read(spark, sf_dir, "mix_target"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_segments": p1_segments, "p2_found": p2_found, "p2_levels": p2_levels, "p3_found": p3_found, "p4_found": p4_found, "p4_share_by_model": p4_share_by_model, "p5_found": p5_found, "p5_copies": p5_copies, "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {}
