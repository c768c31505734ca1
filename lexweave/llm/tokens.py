"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.tokenizers import FOLDER, Ranks
from lexweave.llm.common import settle, spread

#: Folder and file of the vocabulary; every executor must be able to read it.
TOKENIZERS = FOLDER
VOCABULARY = "byte_bpe_50k.tiktoken"
def token_sizes(df: DataFrame, id_col: str, text_col: str = "text", *others: str, path: str | None = None) -> DataFrame:
    """(id, others, tokens): settled, so that several plans can be made from one tokenization; null texts have 0 tokens."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    kept = [id_col, *others]
    src = df.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*kept).schema), "tokens bigint"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Ranks(path)
        for pdf in batches:
            out = pdf[kept].copy()
            out["tokens"] = [len(enc.encode(t)) for t in pdf["__text"].tolist()]
            yield out

    return settle(spread(src).mapInPandas(run, schema))
