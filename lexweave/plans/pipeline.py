"""From configurations to a finished dataset: sample, extract, prompt, generate, pack, cache, unite, clean, count."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import extract as X
from lexweave.operators import learn, pack, post, sampling, stats
from lexweave.operators.generate import generate, length_parameters
from lexweave.sources.io import Config, cached, concatenate, save, settled

ID = "row_idx"


def budget(columns: list[str], most: int) -> Callable[[DataFrame], DataFrame]:
    """Each prompt input cut to its share of the words allowed."""
    share = max(1, most // max(1, len(columns)))
    return lambda df: df.withColumns({c: T.strip(F.array_join(F.slice(T.words(F.col(c)), 1, share), "")) for c in columns})


def inputs(df: DataFrame, config: Config, name: str | None = None) -> DataFrame:
    """The corpus with a column for each placeholder and ``human``, the human text that belongs to a row."""
    name = name or config.extractor
    args = dict(config.extractor_args.get(name, {}))
    text = config.text_column
    if name == "combined":
        out = df
        for part in config.extractors_list:
            part = part.rsplit(".", 1)[0] if "." in part else part
            more = inputs(df, config, part)
            out = out.drop(*[c for c in more.columns if c not in df.columns]).join(more.select(ID, *[c for c in more.columns if c not in df.columns]), ID)
        return out
    if name == "auxiliary":
        return df.withColumns(X.auxiliary(df, config.template)).withColumn("human", F.col(text))
    if name == "dummy":
        return df.withColumns(X.dummy()).withColumn("human", F.col(text))
    if name in ("word_prefix", "sentence_prefix"):
        unit = name.split("_")[0]
        got = X.prefix(df, ID, text, unit, args.get("k"))
        human = "suffix" if config.task in ("detection", "attribution") else "prefix"
        return got.withColumn(f"{unit}s", T.clean_input(F.col("prefix"))).withColumn("human", F.col(human)).drop("prefix", "suffix", "k")
    if name in ("entity_list", "noun_list"):
        made, column = (X_entities, "entities") if name == "entity_list" else (X_nouns, "nouns")
        return df.join(made(df, text).select(ID, column), ID).withColumn("human", F.col(text))
    if name == "example":
        return df.join(X.examples_fixed(df, ID, text, args.get("num_examples", 2), args.get("seed", 13)), ID).withColumn("human", F.col(text))
    raise ValueError(f"{name} makes rows, not columns: see mixcase()")


def X_entities(df: DataFrame, text: str) -> DataFrame:
    return learn.entities(df, ID, text)


def X_nouns(df: DataFrame, text: str) -> DataFrame:
    return learn.nouns(df, ID, text)


def mixed_inputs(df: DataFrame, config: Config, key: str) -> DataFrame:
    """(key, pos, placeholders ...) of an extractor that makes rows; those of masks have spans and positions as well."""
    name = config.extractor
    a = config.extractor_args.get(name, {})
    if name == "sentence_gap":
        return X.sentence_gaps(df, key, "text", a["max_percentage_boundaries"], a["max_sentence_span"], a["gap_token"])
    if name == "word_gap":
        return X.word_gaps(df, key, "text", a["max_percentage_boundaries"], a["max_word_span"], tuple(a["range_boundary_size"]), a["gap_token"])
    if name == "sentence_masking":
        return X.mask_sentences(df, key, "text", tuple(a["percentage_range"]), a["mask_token"]).withColumn("pos", F.lit(0))
    if name == "word_masking":
        return X.mask_words(df, key, "text", tuple(a["percentage_range"]), tuple(a["span_length_range"]), a["mask_token"]).withColumn("pos", F.lit(0))
    if name == "sentence_rewriting":
        return X.sentence_rewrites(df, key, "text", tuple(a["percentage_range"]))
    raise ValueError(f"{name} makes no rows for mixcase")


def mixcase(prompts: DataFrame, humans: DataFrame, config: Config) -> DataFrame:
    """Human texts, and texts with gaps filled or sentences or masks replaced by generations, both with spans as labels.

    Texts and generations are cleaned before spans are counted.  A document from which
    nothing was asked is only a human row.
    """
    key, kind = "__doc", "array<struct<start:int,end:int,label:string>>"

    def texts(df: DataFrame) -> DataFrame:
        again = Window.partitionBy(ID).orderBy(config.text_column)
        named = df.withColumn(key, F.to_json(F.struct(F.col(ID), F.row_number().over(again).alias("n"))))
        return post.drop_empty(post.clean(named.select(ID, key, F.col(config.text_column).alias("text"))))

    docs = settled(texts(prompts))
    asked = mixed_inputs(docs, config, key)
    names = [n for n in X.placeholders(config.template) if n in asked.columns]
    cut = budget(names, config.max_input_tokens)(asked)
    rows = cut.withColumn("prompt", X.fill(config.template, **{n: F.col(n) for n in names})).select(key, "pos", "prompt")
    made = settled(generate(rows, "prompt", config.provider, config.threads, config.generation))
    if config.extractor in ("sentence_gap", "word_gap"):
        pieces = pack.gap_pieces(docs, key, "text", made, T.words if config.extractor == "word_gap" else T.sentences)
    elif config.extractor == "sentence_rewriting":
        pieces = pack.rewrite_pieces(docs, key, "text", made)
    else:
        # the packer knows the masks as MASK-i
        token = config.extractor_args[config.extractor]["mask_token"]
        answer = F.regexp_replace("generation", rf'"{re.escape(token)}-(\d+)"\s*:', '"MASK-$1":')
        pieces = pack.mask_pieces(asked.select(key, "spans", "positions").join(made.select(key, "generation"), key), key, answer)
    generated = F.col("label") == "generated"
    tidy = post.clean(pieces.withColumnRenamed("piece", "text").withColumn("__raw", F.col("text")))
    pieces = settled(tidy.select(key, "pos", "sub", "label", F.when(generated, F.concat("text", F.lit(" "))).otherwise(F.col("__raw")).alias("piece")))
    spans = pack.piece_spans(pieces, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.col("span_label").alias("label")))).alias("spans"))
    told = made.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prompt"))), lambda p: p["prompt"]).alias("prompt"))
    mixed = docs.select(ID, key).join(told, key).join(pack.join_pieces(pieces, key), key).join(spans, key)
    lead, text = F.length("text") - F.length(F.regexp_replace("text", f"^[{T.SPACE}]+", "")), T.strip(F.col("text"))
    moved = F.transform("spans", lambda s: F.struct(F.greatest(s["start"] - lead, F.lit(0)).alias("start"), F.least(s["end"] - lead, F.length(text)).alias("end"), s["label"].alias("label")))
    mixed = mixed.select(ID, "prompt", text.alias("text"), F.filter(moved, lambda s: s["start"] < s["end"]).cast(kind).alias("label"), F.lit(config.model_name).alias("model"), F.lit(config.extractor).alias("extractor"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("human").alias("label"))).cast(kind)
    return texts(humans).select(ID, F.array(F.lit(T.NO_PROMPT)).alias("prompt"), "text", whole.alias("label"), F.lit("human").alias("model"), F.lit(T.NO_EXTRACTOR).alias("extractor")).unionByName(mixed)


def build(corpus: DataFrame, config: Config, key: str, seed: int = 13) -> DataFrame:
    """One labelled table of a run."""
    docs = corpus.where(F.col(config.text_column).isNotNull()).withColumn(ID, F.col(key))
    prompts, humans = sampling.sample_pair(docs, ID, config.quantity, seed, config.random_sample_human)
    if config.task == "mixcase":
        return mixcase(prompts, humans, config).withColumns({"domain": F.lit(config.domain), "language": F.lit(config.language)})
    ready = inputs(prompts, config)
    names = [n for n in X.placeholders(config.template) if n in ready.columns]
    ready = budget(names, config.max_input_tokens)(ready)
    asked = ready.withColumn("prompt", X.fill(config.template, **{n: F.col(n) for n in names}))
    limits = stats.length_limits(humans.withColumn("all", F.lit(1)), F.size(T.words(F.col(config.text_column))), ["all"]).first()
    options = length_parameters(config.provider, limits["min_tokens"], limits["max_tokens"], config.generation) if limits else config.generation
    made = generate(asked, "prompt", config.provider, config.threads, options)
    args = (ID, F.col("prompt"))
    if config.task == "detection":
        out = pack.detection(made, *args, F.col("human"), F.col("generation"), config.model_name, config.extractor)
    elif config.task == "attribution":
        out = pack.attribution(made, *args, F.col("generation"), config.model_name, config.extractor)
    elif config.task == "boundary":
        out = pack.boundary(made, *args, F.col("human"), F.col("generation"), config.model_name, config.extractor)
    else:
        raise ValueError(f"unknown task {config.task}")
    return out.withColumns({"domain": F.lit(config.domain), "language": F.lit(config.language)})


def run(spark: SparkSession, corpora: dict[str, DataFrame], configs: list[Config], run_name: str, key: str, root: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All configurations, each from the cache if a finished run left it; the cleaned union and its statistics before cleaning."""
    if len({c.task for c in configs}) > 1:
        raise ValueError("the configurations of a run must have one task")
    tables = []
    for c in configs:
        done = cached(spark, c, run_name, root)
        if done is None:
            done = save(learn.filter_language(build(corpora[c.dataset], c, key), "text", c.language), c, run_name, root)
        tables.append(done)
    union = concatenate(tables)
    # the rows of one document and of all configurations share its id; a key of its own for each row
    apart = Window.partitionBy("__from", "model", ID).orderBy("text", "prompt")
    numbered = concatenate([t.withColumn("__from", F.lit(i)) for i, t in enumerate(tables)]).withColumn("__n", F.row_number().over(apart))
    keyed = numbered.withColumn("__key", F.to_json(F.struct("__from", "model", ID, "__n")))
    counts = {"domain_model": stats.domain_model_counts(union), "errors": stats.errors_per_model(union)}
    return post.postprocess(keyed, "__key", configs[0].task).select(*union.columns), counts


def show(df: DataFrame, n: int = 5, width: int = 100) -> str:
    """Rows as text panels: prompt, text and label, spans in brackets."""
    out = []
    for r in df.limit(n).collect():
        text = r["text"] or ""
        label = r["label"]
        if isinstance(label, int):
            text = f"{text[:label]}|{text[label:]}"
        elif isinstance(label, list):
            text = "".join(f"[{s[2]}: {text[s[0]:s[1]]}]" for s in label)
        out.append(f"--- {r['model']} ---\n{r['prompt']}\n=> {text[:width]}\n")
    return "\n".join(out)
