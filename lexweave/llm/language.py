"""The language of each text and of each segment of a mixed text, with a confidence (problem 1).

A linear-chain CRF (see crf.py) labels the words; the expected number of words in
each language is the evidence of a sentence, and a chain over the sentences lets a
segment begin only where the evidence outweighs the change.  The model is fitted on
the driver from a bounded sample of labelled documents, has a fixed size and is
broadcast; every text of every table is then labelled in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import is_empty, spread
from lexweave.llm.crf import Crf, fit, words_of
from lexweave.llm.units import units

#: Bounds of the training sample: documents, code points of one, sentences of one.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_UNITS = 3000, 2000, 12
#: Words of evidence that a change of language costs.
CHANGE = 0.8
UND = "und"
_REGION = re.compile(r"^([^\W\d_]+)(?:[-_][^\W_]+)+$")


def label_names(rows: Sequence) -> dict[str, str]:
    """Every lower-cased form of lang_code (lang, iso3, lang_name) and its lang."""
    return {str(form).strip().lower(): r["lang"] for r in rows for form in (r["lang"], r["iso3"], r["lang_name"]) if form}


def named(label: str | None, names: dict[str, str]) -> str | None:
    """The language that a label names in any form, letter case, outer blanks and region suffix; None for no language."""
    if label is None:
        return None
    label = label.strip().lower()
    if label in names:
        return names[label]
    m = _REGION.match(label)
    return names.get(m.group(1)) if m else None


def train(docs: DataFrame, names: dict[str, str], text_col: str = "text", label_col: str = "lang") -> Crf:
    """Fit the CRF on at most SAMPLE_DOCS documents whose label names a language, chosen by a hash of their row."""
    labels = sorted({v for v in names.values() if v != UND})
    some = docs.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(*docs.columns).alias("h"))
    some = some.where(F.length("text").between(20, SAMPLE_CHARS) & F.regexp_replace(F.lower(F.trim("label")), r"[-_].*$", "").isin([n for n, v in names.items() if v != UND]))
    # of all labelled rows about SAMPLE_DOCS and a fifth, by a hash of the whole row, so that what reaches the driver does not
    # grow with the tasks nor with a text that recurs
    share = F.pmod("h", F.greatest(F.lit(some.count()), F.lit(1))) < SAMPLE_DOCS + SAMPLE_DOCS // 5
    rows = some.where(share).orderBy("h", "text").limit(SAMPLE_DOCS).collect()
    sentences = []
    for r in rows:
        lang = named(r["label"], names)
        if lang in labels:
            for a, b in units(r["text"])[:SAMPLE_UNITS]:
                words = words_of(r["text"][a:b])
                if words:
                    sentences.append((words, labels.index(lang)))
    return fit(sentences, labels)


class Judge:
    """Evidence of sentences, kept for sentences that recur; the memory is emptied when it is full."""

    FULL = 100_000

    def __init__(self, model: Crf) -> None:
        self.model, self.labels = model, model.labels
        self.known: dict[str, np.ndarray | None] = {}

    def learn(self, sentences: list[str]) -> None:
        """Judge all new sentences of a batch at once."""
        if len(self.known) > self.FULL:
            self.known.clear()
        new = [s for s in dict.fromkeys(sentences) if s not in self.known]
        words = [words_of(s) for s in new]
        for s, w, p in zip(new, words, self.model.posteriors(words)):
            self.known[s] = p if w else None

    def segments(self, text: str, bounds: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
        """(start, end, lang, confidence) of the runs of sentences in one language; learn() must have seen the sentences."""
        if not bounds:
            return []
        proof = [self.known[text[a:b]] for a, b in bounds]
        told = [k for k, p in enumerate(proof) if p is not None]
        if not told:
            return [(bounds[0][0], bounds[-1][1], UND, 1.0)]
        best = [int(proof[k].argmax()) for k in told]
        if len(set(best)) > 1:
            best = self._chain([proof[k] for k in told])
        out: list[list] = []
        for n, (k, y) in enumerate(zip(told, best)):
            p = proof[k]
            if not out or out[-1][2] != y:
                # sentences without words belong to the segment before them, the first ones to the first
                out.append([bounds[k][0] if n else bounds[0][0], 0, y, 0.0, 0.0])
            seg = out[-1]
            seg[3] += float(p[y])
            seg[4] += float(p.sum())
            upto = told[n + 1] if n + 1 < len(told) else len(bounds)
            seg[1] = bounds[upto - 1][1]
        return [(a, b, self.labels[y], round(good / max(total, 1e-9), 4)) for a, b, y, good, total in out]

    @staticmethod
    def _chain(proof: list[np.ndarray]) -> list[int]:
        """The best labels of the sentences when each change costs CHANGE words."""
        score, back = proof[0].copy(), []
        for p in proof[1:]:
            top = int(score.argmax())
            stay = score >= score[top] - CHANGE
            back.append(np.where(stay, np.arange(len(score)), top))
            score = np.where(stay, score, score[top] - CHANGE) + p
        y = int(score.argmax())
        path = [y]
        for step in reversed(back):
            y = int(step[y])
            path.append(y)
        return path[::-1]


def segments(df: DataFrame, docs: DataFrame, codes: DataFrame, keys: Sequence[str], text_col: str, label_col: str) -> DataFrame:
    """(keys, seg_no, start_pos, end_pos, lang, confidence, segs, named): a row per segment of each text that is not empty.

    named: the label names the language of this segment.  Null texts and labels,
    repeated rows and empty tables need nothing special: a null label names nothing.
    """
    names = label_names(codes.collect())
    return label_segments(df, train(docs, names), names, keys, text_col, label_col)


def label_segments(df: DataFrame, model: Crf, names: dict[str, str], keys: Sequence[str], text_col: str, label_col: str) -> DataFrame:
    src = df.select(*keys, F.col(text_col).alias("__text"), F.col(label_col).cast("string").alias("__label")).where(~is_empty(F.col("__text")))
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value)
        for pdf in batches:
            texts = pdf["__text"].tolist()
            bounds = [units(t) for t in texts]
            judge.learn([t[a:b] for t, bs in zip(texts, bounds) for a, b in bs])
            at: list[int] = []
            rows: list[tuple] = []
            for k, (t, bs, label) in enumerate(zip(texts, bounds, pdf["__label"].tolist())):
                segs = judge.segments(t, bs)
                says = named(label, names)
                for n, (a, b, lang, sure) in enumerate(segs):
                    at.append(k)
                    rows.append((n + 1, a, b, lang, sure, len(segs), says == lang))
            out = pdf[kept].iloc[at].reset_index(drop=True)
            more = pd.DataFrame(rows, columns=["seg_no", "start_pos", "end_pos", "lang", "confidence", "segs", "named"])
            yield pd.concat([out, more], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keys).schema), "seg_no bigint, start_pos int, end_pos int, lang string, confidence double, segs int, named boolean"])
    return spread(src).mapInPandas(run, schema)
