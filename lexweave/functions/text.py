"""Column functions on text: cleaning, lossless words and sentences, n-grams, seeded random numbers.

All are built-in expressions, so they stay in the JVM and work on streams as well.
A null text gives null everywhere; an empty text gives an empty text or array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python strips it, special tokens and disclosure phrases that are removed.
SPACE = r" \t\n\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPECIAL_TOKENS = ["CLS", "SEP", "PAD", "MASK", "UNK", "BOS", "EOS", "EOD", "EOP", "endoftext"]
DISCLOSURES = [
    "As an AI language model",
    "I am sorry, I am an AI language model and",
    "I am sorry, I'm an AI language model and",
    "I'm sorry, I'm an AI language model and",
    "I'm sorry, I am an AI language model and",
    "I'm sorry, but I am an AI language model and",
]
WORDS = r"[^ \t\n\r\f]+[ \t\n\r\f]*"
SENTENCES = r"[^.!?]+[.!?]*[ \t\n\r\f]*|[.!?]+[ \t\n\r\f]*"
ERROR, OMITTED, NO_PROMPT, NO_EXTRACTOR = "<error>", "<omitted>", "NO-PROMPT", "NO-EXTRACTOR"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only: the same on any layout, engine and retry."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def randint(seed: int, low: Column | int, high: Column | int, *keys: Column) -> Column:
    """A whole number from low to high, both included."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (low + F.floor(uniform(seed, *keys) * (high - low + 1))).cast("int")


def order_key(seed: int, key: Column) -> Column:
    """A seeded shuffle sorts by this."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def clean_input(text: Column) -> Column:
    """Line breaks, tabs, arrows and colons become spaces, runs of spaces one, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"->|[\n\t\r:]", " "), " +", " "))


def strip(text: Column) -> Column:
    """White space off both ends, any Unicode white space included."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def remove_special_tokens(text: Column) -> Column:
    """Model tokens in brackets, then the bare words, wherever they stand."""
    bracketed = [rf"\[{t}\]" for t in SPECIAL_TOKENS[:-1]] + [f"<{SPECIAL_TOKENS[-1]}>"]
    return F.regexp_replace(text, "|".join(bracketed + SPECIAL_TOKENS), "")


def capitalize(text: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def remove_disclosures(text: Column) -> Column:
    """Disclosure phrases up to the next word; a text that held one is capitalised."""
    out = text
    for phrase in DISCLOSURES:
        out = F.regexp_replace(out, rf"(?iU){phrase}.+?(?=\w)", "")
    # most texts hold none of the phrases and are let through by one search
    return F.when(text.rlike("(?i)an AI language model"), F.when(out != text, capitalize(out)).otherwise(text)).otherwise(text)


def words(text: Column) -> Column:
    """Words with the white space behind them; they join to the text again if it has none in front."""
    return F.regexp_extract_all(text, F.lit(WORDS), 0)


def sentences(text: Column) -> Column:
    """Sentences by end marks with the white space behind them; they join to the text again."""
    return F.regexp_extract_all(text, F.lit(SENTENCES), 0)


def bare_words(text: Column) -> Column:
    """Words as white space parts them, without it."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a separator no token holds; none where there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), "\x1f"))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def unique_share(tokens: Column, n: int) -> Column:
    """Distinct n-grams by n-grams; 0 where there is none."""
    grams = ngrams(tokens, n)
    return F.when(F.size(tokens) >= n, F.size(F.array_distinct(grams)) / F.size(grams)).otherwise(F.lit(0.0))
