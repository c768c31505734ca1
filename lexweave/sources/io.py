"""Sources and sinks: corpora, configurations, a cache of built tables, statistics."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Tasks, extractors with the arguments each must have, language codes of two letters or this word.
TASKS = ("detection", "attribution", "boundary", "mixcase")
EXTRACTORS: dict[str, tuple[str, ...]] = {
    "auxiliary": (), "combined": (), "dummy": (), "entity_list": (), "noun_list": (), "sentence_prefix": (), "word_prefix": (), "example": (),
    "sentence_gap": ("gap_token", "max_percentage_boundaries", "max_sentence_span"),
    "word_gap": ("gap_token", "max_percentage_boundaries", "max_word_span", "range_boundary_size"),
    "sentence_masking": ("mask_token", "percentage_range"),
    "word_masking": ("mask_token", "percentage_range", "span_length_range"),
    "sentence_rewriting": ("percentage_range",),
}
MULTILINGUAL = "multilingual"


class ConfigError(ValueError):
    """A configuration that cannot be run, with the reason."""


@dataclass(frozen=True)
class Config:
    """One run: input, model and generation settings. Frozen, so that its cache key cannot change during the run."""

    task: str
    domain: str
    dataset: str
    text_column: str
    template: str
    extractor: str
    provider: str
    model_name: str
    quantity: int = 10
    dataset_params: dict = field(default_factory=dict)
    extractors_list: tuple[str, ...] = ()
    extractor_args: dict = field(default_factory=dict)
    random_sample_human: bool = False
    max_input_tokens: int = 256
    language: str = "en"
    threads: int = 8
    api_type: str = "COMPLETION"
    generation: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.task not in TASKS:
            raise ConfigError(f"unknown task {self.task!r}")
        if self.extractor not in EXTRACTORS:
            raise ConfigError(f"unknown extractor {self.extractor!r}")
        if (self.extractor == "combined") != bool(self.extractors_list):
            raise ConfigError("a list of extractors belongs to the combined extractor, and to no other")
        missing = [a for a in EXTRACTORS[self.extractor] if a not in self.extractor_args.get(self.extractor, {})]
        if missing:
            raise ConfigError(f"{self.extractor} needs {', '.join(missing)}")
        if self.quantity <= 0 or self.max_input_tokens <= 0 or self.threads <= 0:
            raise ConfigError("quantity, max_input_tokens and threads must be positive")
        if self.language != MULTILINGUAL and not (len(self.language) == 2 and self.language.isalpha()):
            raise ConfigError(f"unknown language {self.language!r}")
        if self.task == "boundary" and self.random_sample_human:
            raise ConfigError("boundary texts continue their own human prefix, so random_sample_human must be off")

    def key(self) -> str:
        """SHA-256 of the settings."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=list).encode()).hexdigest()


def load_config(path: str, task: str, most: int | None = None) -> Config:
    """A YAML file with the sections input, model and generation; ``most`` caps the quantity."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text())
    given, model = dict(raw["input"]), dict(raw["model"])
    given["text_column"] = given.pop("dataset_text_column")
    if most is not None:
        given["quantity"] = min(given.get("quantity", most), most)
    named = {k: v for k, v in model.items() if k in ("provider", "model_name", "threads", "api_type")}
    extra = {k: v for k, v in model.items() if k not in named}
    if "extractors_list" in given:
        given["extractors_list"] = tuple(given["extractors_list"])
    return Config(task=task, **given, **named, generation={**extra, **raw.get("generation", {})})


def load_configs(folder: str, task: str, most: int | None = None) -> list[Config]:
    """All *.yml and *.yaml below a folder, or one file; an empty folder is an error."""
    root = Path(folder)
    files = [root] if root.is_file() else sorted([*root.rglob("*.yml"), *root.rglob("*.yaml")])
    if not files:
        raise ConfigError(f"no configuration in {folder}")
    return [load_config(str(f), task, most) for f in files]


def load_corpus(spark: SparkSession, path: str, split: str | None = None, kind: str = "parquet", **options: object) -> DataFrame:
    """A table in any format that Spark reads; a split is a value of the column ``split``."""
    df = spark.read.format(kind).options(**options).load(path)
    return df.where(df["split"] == split) if split is not None else df


def settled(df: DataFrame) -> DataFrame:
    """The rows written once to the folder all executors share: nothing is computed twice, or asked of a provider again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lexweave-"))
    # a written table takes a part of the disk that a checkpoint of rows does; it goes when the driver ends
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/settled-{uuid.uuid4().hex}")
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(at.toString())
    return df.sparkSession.read.schema(df.schema).parquet(at.toString())


def cache_root(spark: SparkSession) -> str:
    """LEXWEAVE_CACHE_DIR, else a folder of the machine, which only a local master may use."""
    root = os.environ.get("LEXWEAVE_CACHE_DIR")
    if root is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set LEXWEAVE_CACHE_DIR to a folder that all executors share")
    return root or "/tmp/lexweave-cache"


def cached(spark: SparkSession, config: Config, run: str, root: str | None = None) -> DataFrame | None:
    """The table that a finished run of this configuration left, or none; looked up in the file system of the path."""
    at = "/".join([root or cache_root(spark), run, config.key()])
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    return spark.read.parquet(at) if mark.getFileSystem(hadoop).exists(mark) else None


def save(df: DataFrame, config: Config, run: str, root: str | None = None) -> DataFrame:
    """Write a built table under its key and read it back, so that nothing generated is generated twice."""
    at = "/".join([root or cache_root(df.sparkSession), run, config.key()])
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.parquet(at)


def concatenate(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def save_statistics(df: DataFrame, path: str, name: str) -> None:
    """A small table as JSON lines and as Markdown."""
    rows = df.collect()
    Path(path).mkdir(parents=True, exist_ok=True)
    Path(path, f"{name}.json").write_text("".join(json.dumps(r.asDict(), default=str) + "\n" for r in rows))
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
    Path(path, f"{name}.md").write_text(head + "".join("| " + " | ".join(str(v) for v in r) + " |\n" for r in rows))
