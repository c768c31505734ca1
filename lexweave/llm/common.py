"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything between two words; a point, comma or colon between two digits belongs to the word.
BETWEEN_WORDS = r"(?:[^\p{L}\p{M}\p{Nd}.,:]|(?<!\p{Nd})[.,:]|[.,:](?!\p{Nd}))+"
# What a missing answer or a failed generation leaves behind, without its signs.
EMPTY_MARKERS = [
    "error", "null", "none", "nan", "nil", "n a", "na", "pad", "eos", "bos", "s", "unk", "mask", "sep", "cls",
    "endoftext", "end of text", "startoftext", "no response", "no answer", "no output", "no text", "no content",
    "empty", "blank", "undefined", "missing", "not available", "generation failed", "failed", "timeout", "timed out",
]
#: An announcement is one line of at most this many code points that ends with a colon.
ANNOUNCEMENT = 60


def spread(df: DataFrame, waves: int = 3) -> DataFrame:
    """The rows over at least ``waves`` tasks a core, for stages bound by Python; moved only where the files give fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * waves)


def settle(df: DataFrame) -> DataFrame:
    """The rows written once to the folder all executors share, so that nothing is computed twice or lost with an executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lexweave-"))
    return df.checkpoint()


def words(text: Column) -> Column:
    """The lower-cased words of a text, parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), BETWEEN_WORDS, " "))


# A marker and its repetitions, and nothing else that shows; anchored, so that most texts of any length fail at their first word.
_NOTHING = r"[^\p{L}\p{M}\p{Nd}]"
_MARKER = "|".join(m.replace(" ", f"{_NOTHING}+") for m in sorted(EMPTY_MARKERS, key=len, reverse=True))
ONLY_MARKERS = rf"(?iu)^{_NOTHING}*+(?:({_MARKER})(?:{_NOTHING}++\1)*+{_NOTHING}*+)?$"


def is_empty(text: Column) -> Column:
    """Null, nothing to see, only a marker for a missing answer (once or repeated), or only the announcement of one. Never null."""
    announced = (F.length(text) <= ANNOUNCEMENT) & text.rlike(r"(?U)^\s*\S[^\n]*[:：][\s*_\"'»”)\]]*$")
    return F.coalesce(text.rlike(ONLY_MARKERS) | announced, F.lit(True))
