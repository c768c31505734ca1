"""The reading level of each English text (problem 2).

A smoothed unigram language model per band is trained on the samples of that band;
a text gets the band under which its words are most likely, with the posterior.
The models are a table of fixed size (the words of the samples) and are broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import is_empty, settle, spread
from lexweave.llm.crf import Crf
from lexweave.llm.cutoff import truncated
from lexweave.llm.pairs import NO_PROMPT, Pairs
from lexweave.llm.units import units

#: Pseudo-count of every word in every band; fewest words of a text that gets a band.
SMOOTHING, LEAST_WORDS = 0.5, 40
#: Words of evidence of a sentence whose script or stopwords leave no doubt.
SURE = 5.0
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


class Levels:
    """Log-likelihood ratios of words under each band."""

    def __init__(self, samples: Sequence[tuple[str, str]]) -> None:
        self.bands = sorted({band for _, band in samples if band})
        counts = [Counter(w for text, b in samples if b == band and text for w in _words(text)) for band in self.bands]
        vocabulary = set().union(*counts) if counts else set()
        totals = [sum(c.values()) + SMOOTHING * (len(vocabulary) + 1) for c in counts]
        # a word that no sample has says nothing
        self.logs = {w: np.log([(c[w] + SMOOTHING) / t for c, t in zip(counts, totals)]) for w in vocabulary}

    def posterior(self, text: str) -> np.ndarray | None:
        """None for a text without a known word."""
        known = [p for w in _words(text) if (p := self.logs.get(w)) is not None]
        if not known:
            return None
        score = np.sum(known, 0)
        score = np.exp(score - score.max())
        return score / score.sum()

    def band(self, text: str) -> tuple[str | None, float | None]:
        p = self.posterior(text)
        if p is None:
            return None, None
        k = int(p.argmax())
        return self.bands[k], float(p[k])


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("’", "'"))


class English:
    """Finds the texts that are wholly English: by the script and stopwords of their sentences, else by the language model."""

    def __init__(self, language: Crf) -> None:
        self.pairs = Pairs(language)

    def wholly(self, texts: list[str]) -> list[bool]:
        judge, glance = self.pairs.judge, self.pairs.glance
        if "en" not in judge.labels:
            return [False] * len(texts)
        bounds: list[list[tuple[int, int]]] = []
        seen: dict[str, str | None] = {}
        for t in texts:
            # a first sentence that is surely in another language settles a text
            first = [t[a:b] for a, b in units(t, 1)]
            bounds.append(units(t) if first and glance(first[0]) in ("en", None) else [])
            for a, b in bounds[-1]:
                if (s := t[a:b]) not in seen:
                    seen[s] = glance(s)
        judge.learn([s for s, lang in seen.items() if lang is None])
        for s, lang in seen.items():
            if lang is not None:
                judge.known[s] = SURE * np.eye(len(judge.labels), dtype=np.float32)[judge.labels.index(lang)]
        out = []
        for t, bs in zip(texts, bounds):
            segs = judge.segments(t, bs)
            out.append(len(segs) == 1 and segs[0][2] == "en")
        return out


def levels(df: DataFrame, samples: DataFrame, language: Crf, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id, band, confidence) of every text that is not empty.

    The models are English: a text that is not wholly English, or has no word of the
    samples, gets a null band and confidence.  Ties go to the first band by name,
    repeated rows are graded again, an empty table gives none.
    """
    model = Levels([(r["text"], r["band"]) for r in samples.select("text", "band").collect()])
    shared = df.sparkSession.sparkContext.broadcast((model, language))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, english = shared.value[0], English(shared.value[1])
        for pdf in batches:
            texts = pdf["text"].tolist()
            got = [bands.band(t) if ok else (None, None) for t, ok in zip(texts, english.wholly(texts))]
            yield pd.DataFrame({"id": pdf["id"], "band": pd.Series([b for b, _ in got], dtype="object"), "confidence": pd.Series([c for _, c in got], dtype="float64")})

    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where(~is_empty(F.col("text")))
    graded = spread(src).mapInPandas(run, "id bigint, band string, confidence double")
    return graded.select("id", "band", F.when(F.col("band").isNotNull(), F.col("confidence")).alias("confidence")).withColumnRenamed("id", id_col)


def sound_english(df: DataFrame, samples: DataFrame, language: Crf, id_col: str = "row_id", prompt_col: str = "prompt", text_col: str = "text") -> DataFrame:
    """(id, band) of the texts that are wholly English, long enough, not empty, not cut and no defective answer.

    Whether a text is cut (cutoff.truncated) is asked last, of those alone that meet all the rest.
    """
    model = Levels([(r["text"], r["band"]) for r in samples.select("text", "band").collect()])
    shared = df.sparkSession.sparkContext.broadcast((model, language))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, english = shared.value[0], English(shared.value[1])
        for pdf in batches:
            texts = pdf["text"].tolist()
            kept = pdf[english.wholly(texts)]
            asked = kept["prompt"].notna()
            broken = english.pairs.defects(list(zip(kept["prompt"][asked].tolist(), kept["text"][asked].tolist())))
            good = kept.drop(index=[k for k, d in zip(kept.index[asked], broken) if d])
            yield pd.DataFrame({"id": good["id"], "band": pd.Series([bands.band(t)[0] for t in good["text"]], index=good.index, dtype="object")})

    text, prompt = F.col(text_col).cast("string"), F.col(prompt_col).cast("string")
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.when(F.trim(prompt) != NO_PROMPT, prompt).alias("prompt"), text.alias("text"))
    # the words are counted before Python; a text without a Latin letter is not English
    src = src.where(~is_empty(F.col("text")) & F.col("text").rlike(rf"(?U)^\s*+(?:\S++\s++){{{LEAST_WORDS - 1}}}+\S") & F.col("text").rlike("[A-Za-z]{2}"))
    found = settle(spread(src).mapInPandas(run, "id bigint, band string").where("band is not null"))
    cut = truncated(df, id_col, text_col, among=found.select(F.col("id").alias(id_col)))
    return found.join(cut.select(F.col(id_col).cast("bigint").alias("id")), "id", "left_anti").withColumnRenamed("id", id_col)
