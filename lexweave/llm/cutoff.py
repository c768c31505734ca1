"""Texts cut off by a field limit (problem 4), in Spark SQL alone.

The word trigrams of all texts are counted, apart, where a word follows them and
where a sentence, line or text ends.  The final trigram of each text that has no
proper end is joined with these counts: one that is frequent inside texts but almost
never ends a sentence marks a cut.  Trigrams that do both are decided by the longest
context that is known, and a last word that is no word by the words that follow the
same pair elsewhere.  Scripts without spaces count by character.  Where a text in
question stops is no proof of an end: those places are taken off all counts, so that
copies of a cut text, or other texts cut at the same place, do not vouch for it.

Plan: one pass over the ends of the texts finds those in question; the beginnings of
their final trigrams set bits in a table that is sized by their number.  It is
broadcast, so that the pass over all texts builds contexts only where such a trigram
can stand; those are pre-aggregated before the shuffle and joined on hashed keys.
Where the table would pass MAP_LIMIT it is left out, and every trigram is counted.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import is_empty, settle, spread
from lexweave.llm.units import NEVER_FINAL

#: Bits of the table for each trigram asked for, and the most bits that are broadcast (2 ** 27 are 40 MB there); a
#: collision costs time and no result.
MAP_SHARE, MAP_LIMIT = 12, 27
#: Lengths of the contexts: words, and characters of scripts without spaces.
LEVELS, CHAR_LEVELS = (3, 4, 5, 6, 8), (3, 5, 8, 10)
REACH = 10
#: Least count for a context to be believed, and the share of ends under which it marks a cut.
SUPPORT, ENDS = 3, 0.2
#: Code points in which decoration behind the break is looked for first; what fills them is looked for in the whole text.
NEAR = 60

CHARS = r"\x{e01}-\x{e7f}\x{3040}-\x{30ff}\x{3400}-\x{9fff}"
# one class decides at most characters, by its ranges; what follows is looked at only behind a mark or line break
BOUNDARY = (
    r"[.!?\n\r[\x{61f}-\x{964}&&[؟۔।]][\x{2026}-\x{ff1f}&&[…。！？]]](?:(?<=[.!?…])[.!?…]*+[\"”“»’')\]*_]*+(?=\s+[\"“«„¿¡(\[*_>•\-]*[\p{Lu}\p{Lo}\p{Nd}]|\s*$)"
    r"|(?<=[\n\r])\s*+|(?<=[。！？।؟۔])[。！？।؟۔]*+[\"”»」』)）*_]*+)"
)
# where a script has no marks, a space parts
THAI, THAI_SPACE = "[ก-๎]", r" +(?<=[ก-๎\"] {1,9})(?=[\"ก-๎])"
# what gives a Latin letter in lower case
LATIN = r"[A-Za-z\x{130}\x{212a}]"
_LIGHT = r"\s*_\"'“”„»«)\]}>|~=`）」』\p{So}\p{Sk}\p{Cf}\x{FE0F}"
# possessive, and begun only where no run of it has begun: linear in the length of the text
DECORATION = (
    rf"(?=[{_LIGHT}\[#h\p{{Nd}}—–-])(?<![{_LIGHT}])(?:[{_LIGHT}]++|\[\d+\]|\[(?:\.\.\.|…)\]|#[\p{{L}}\p{{M}}\p{{Nd}}_]++"
    r"|https?://\S++|(?<![\p{Nd}.,])\d++/\d++|(?<=\s)[—–-]\s*+\p{L}[.;,…]++\s*+\p{L}[.;]?)++$"
)
OPENING = "([{\"«“„（「『"
STOPS = r"[.!?…。！？।؟۔,:;，、；：،\-–—\x{FFFD}\s(“«„\"]++$"
# marks of the last paragraph by what they do there; what stands in an emoticon or behind a figure opens nothing
ROLES = [
    (r"(?<=[:;=])[(\[{)\]}]+|(?<=[:;=]-)[(\[{)\]}]+", ""),
    (r"“(?![\p{L}\p{M}\p{Nd}\"(\[«¿¡'‘…])", "”"),
    (r"(?<![\p{L}\p{M}\p{Nd}.!?…,;:])\"(?=\S)", "“"),
    (r"(?<=\p{Nd})\"|\"(?![\p{L}\p{Nd}])", "”"),
    (r"[«»](?=\p{L})(?<![\p{L}\p{M}\p{Nd}.!?…].)", "«"),
    (r"(?<=[\p{L}\p{M}.!?…])[«»](?![\p{L}\p{Nd}])", "»"),
    (r"[(\[{（「『](?![\s]*[\p{L}\p{M}\p{Nd}\"“„«(\[{「『#@¿¡'‘…<*_$€£+~—–-])", ""),
]
_MARKS = r"()\[\]{}«»\"“-„「-』（-）"
_KINDS, _ENDS = "([{（「『«““", ")]}）」』»”\""


def tokens(text: Column) -> Column:
    """array<string>: lower-cased words, single characters of scripts without spaces, "¶" first and where something ends."""
    marked = F.concat(F.lit("¶ "), text)
    # a text of ASCII alone holds none of the scripts that are parted by characters
    other = F.octet_length(text) > F.length(text)
    parted = F.when(other & text.rlike(THAI), F.regexp_replace(marked, THAI_SPACE, " ¶ ")).otherwise(marked)
    plain = F.lower(F.regexp_replace(parted, BOUNDARY, " ¶ "))
    plain = F.when(other, F.regexp_replace(plain, rf"[{CHARS}]\p{{M}}*+", " $0 ")).otherwise(plain)
    return F.split(plain, r"[^\p{L}\p{M}\p{Nd}¶'’]++")


def _open(last: Column) -> Column:
    """Does a quotation or bracket stay open in the last paragraph? A stack of the marks that open and close there."""
    # of what stands between two marks only the first two characters and the last tell anything
    pieces = F.split(last, rf"(?<=[{_MARKS}])|(?=[{_MARKS}])")
    last = F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) > 3, F.concat(F.left(p, F.lit(2)), F.right(p, F.lit(1)))).otherwise(p)), "")
    for pattern, role in ROLES:
        last = F.regexp_replace(last, pattern, role)
    marks = F.split(F.regexp_replace(F.translate(last, "„", "“"), rf"[^{_MARKS}]++", ""), "")

    def read(stack: Column, m: Column) -> Column:
        # what closes takes with it what never closed inside; a straight mark between letters closes what is open, else it opens
        back = F.call_function("instr", F.reverse(stack), F.translate(m, _ENDS, _KINDS))
        closed = F.left(stack, F.length(stack) - back)
        return F.when(m.isin(*_KINDS) | (m == '"') & (back == 0), F.concat(stack, F.translate(m, '"', "“"))).when((m != "") & (back > 0), closed).otherwise(stack)

    return F.aggregate(marks, F.lit(""), read) != ""


def _fence(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with more columns, each computed once: no filter or later expression can be pushed below."""
    keep = [F.col(c) for c in df.columns]
    return df.select(F.explode(F.array(F.struct(*keep, *[c.alias(n) for n, c in columns.items()]))).alias("e")).select("e.*")


def _bare(text: Column) -> Column:
    """The text without decoration behind it, looked for in a short end first."""

    def within(most: int, beyond: Column) -> Column:
        near = F.regexp_replace(F.right(text, F.lit(most)), DECORATION, "")
        # a run that reaches beyond leaves no blank behind which it could have begun
        done = (F.length(text) <= most) | near.rlike(r"\s\S")
        return F.when(done, F.concat(F.left(text, F.greatest(F.length(text) - most, F.lit(0))), near)).otherwise(beyond)

    return within(NEAR, F.regexp_replace(text, DECORATION, ""))


def tails(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sure, seen, t) of the texts that may be cut: t, their tokens up to the break; sure: cut beyond doubt; seen: what those who count see behind the break."""
    raw = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("text is not null")
    # shortcuts only: no abbreviation is as long, such marks are strong, and nothing is open
    whole = F.right("text", F.lit(9)).rlike(r"(?:[\p{L}\p{M}]{7}[.]|[\p{L}\p{M}]{2}[!?。！？।؟])$")
    opened = reduce(or_, [F.contains("text", F.lit(ch)) for ch in OPENING])
    cut = _fence(raw, opened=opened).where(F.col("opened") | ~whole).where(~is_empty(F.col("text")))
    # most texts end with a word and its mark: nothing to strip there
    plain = F.right("text", F.lit(8)).rlike(r"[\p{L}\p{M}]{4}[.!?。！？।؟]$")
    bare = _fence(cut, bare=F.when(plain, F.col("text")).otherwise(_bare(F.col("text"))), last=F.when(F.col("opened"), F.element_at(F.split("text", r"\n\s*\n"), -1)))
    # the word before a final point: one that never ends a sentence, an initial, or a figure or address that may go on
    end = _fence(bare.select("*", F.right("bare", F.lit(24)).alias("end"), F.col("bare").endswith(".").alias("point")))
    end = _fence(end, word=F.when(F.col("point"), F.lower(F.regexp_extract(F.right("end", F.lit(16)), r"([\p{L}\p{M}.ª-]*[\p{L}\p{M}ª-])\.$", 1))))
    titles = sorted({w for w in NEVER_FINAL.split() if w not in ("on", "no", "es", "in", "ing", "is")})
    never = F.col("word").isin(titles) | F.substring_index("word", "-", -1).isin(titles) | F.right("end", F.lit(3)).rlike(r"(?<![\p{L}\p{M}.\p{Nd}’'])\p{L}\.$")
    doubtful = F.col("end").rlike(r"(?:\p{Nd}|[\p{L}\p{Nd}]\.[\p{L}\p{Nd}]++)\.$")
    strong = F.right("end", F.lit(3)).rlike(r"(?:(?<![.。।۔…!?！？؟])[.。।۔]|(?<![!?！？؟…])[!?！？؟]{1,2})$")
    sure = F.when(F.col("word") != "", never).otherwise(False) | F.when(F.col("last").isNotNull(), _open(F.col("last"))).otherwise(False)
    left = _fence(end.select("id", "text", "bare", sure.alias("sure"), F.when(strong, ~F.when(F.col("point"), doubtful).otherwise(False)).otherwise(False).alias("strong")))
    left = left.where("sure or not strong").withColumn("lettered", F.element_at(F.split("bare", "\n"), -1).rlike(r"\p{L}"))
    asked = _fence(left.where("sure or (not strong and lettered)").select("id", "sure", "text", F.regexp_replace(F.regexp_replace(F.regexp_replace("bare", STOPS, ""), DECORATION, ""), STOPS, "").alias("core")))
    behind = F.substring(F.col("text"), F.length("core") + 1, F.length("text"))
    # the last token as it begins there, with what follows; null where it goes on in another way, and is another token
    stem = F.when(F.right("core", F.lit(1)).rlike(r"[\p{L}\p{M}\p{Nd}]"), F.right("core", F.lit(1))).otherwise("x")
    seen = _fence(asked.select("id", "sure", "core", stem.alias("stem"), tokens(F.concat(stem, behind)).alias("b")))
    seen = seen.select("id", "sure", "core", F.when(F.get("b", F.lit(1)) == F.lower("stem"), F.get("b", F.lit(2))).alias("seen"))
    t = _fence(seen.select("id", "sure", "seen", F.filter(tokens(F.col("core")), lambda w: w != "").alias("t")))
    return t.where(F.element_at("t", -1) != "¶")


def _is_char(token: Column) -> Column:
    """Is this a character of a script without spaces? By the order of code points, without a pattern."""
    within = [(token >= lo) & (token < hi) for lo, hi in (("ก", "຀"), ("぀", "㄀"), ("㐀", "ꀀ"))]
    return within[0] | within[1] | within[2]


def _back(at: Column, k: int) -> Column:
    """The token k places before ``at`` as it is counted: any figure is one; null beyond the beginning."""
    w = F.get("t", at - k)
    return F.when((w >= "0") & (w < ":"), "0").otherwise(w)


def _begun(at: Column) -> Column:
    """Hash of what is known of a final trigram before it is looked up: its pair and the first character of its last word."""
    return F.xxhash64(_back(at, 2), _back(at, 1), F.left(_back(at, 0), F.lit(1)))


def _grams(df: DataFrame) -> DataFrame:
    """The rows with a hash g3 .. of their last k tokens w0, w1 .. for each k in LEVELS and CHAR_LEVELS; each goes on from the shorter one."""
    done, before = 0, F.lit(1)
    for k in sorted({*LEVELS, *CHAR_LEVELS}):
        df = df.select("*", F.xxhash64(before, *[f"w{i}" for i in range(done, k)]).alias(f"g{k}"))
        done, before = k, F.col(f"g{k}")
    return df


def _levels(first: list[Column]) -> Column:
    """array<bigint>: ``first`` and the hashes of the last token's kind."""
    return F.when(_is_char(F.col("w0")), F.array(*[f"g{k}" for k in CHAR_LEVELS])).otherwise(F.array(*first, *[f"g{k}" for k in LEVELS]))


def _pair() -> Column:
    """Hash of the pair before the last token."""
    return F.xxhash64(F.lit(2), "w1", "w2")


def _mapped(keys: DataFrame, name: str, bits: int) -> DataFrame:
    """(word, set): a table of 2 ** bits bits, one set for each hash in the column ``name``."""
    at = keys.select(F.shiftrightunsigned(name, 64 - bits).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
    return at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(one).alias("set"))


def _set(name: str, bits: int) -> Column:
    """The condition of a join with such a table: the bit of the hash in the column ``name`` is set."""
    p = F.shiftrightunsigned(name, 64 - bits)
    return (F.shiftright(p, 6) == F.col("word")) & (F.call_function("getbit", F.col("set"), (p % 64).cast("int")) == 1)


def truncated(df: DataFrame, id_col: str = "row_id", text_col: str = "text", map_limit: int = MAP_LIMIT, among: DataFrame | None = None) -> DataFrame:
    """(id): the rows whose text breaks off inside a sentence or word, whatever stands after the break.

    Where ``among`` is given, only its ids, of texts with a Latin letter, are asked for, and
    of others some may come out.  All places where their trigrams can stand are counted as
    before: a text without a Latin letter is read if one of these trigrams has none either.

    Empty texts (null, blank, markers, bare announcements) are no cases.  Repeated rows
    are judged each for itself, and none by where another in question stops; an empty
    table gives none, other columns are not read.
    """
    df = spread(df.select(id_col, text_col))
    last = (F.size("t") - 1).cast("int")

    def ask(rows: DataFrame) -> DataFrame:
        found = tails(rows, id_col, text_col).select("id", "sure", "seen", _begun(last).alias("begun"), *[_back(last, k).alias(f"w{k}") for k in range(REACH)])
        lettered = F.concat_ws("", "w2", "w1", F.left("w0", F.lit(1))).rlike("[a-z]")
        return settle(_grams(found).select(F.monotonically_increasing_id().alias("u"), "id", "sure", "seen", F.col("w0").alias("part"), "begun", lettered.alias("lettered"), _levels([_pair()]).alias("asks")))

    latin = df[text_col].rlike(LATIN)
    asked = ask(df if among is None else df.where(latin))
    unsure = asked.where("not sure")
    if among is None:
        count = unsure.count()
    else:
        unsure = settle(unsure.join(among.select(F.col(id_col).alias("id")), "id", "left_semi"))
        count, plain = unsure.select(F.count(F.lit(1)), F.count_if(~F.col("lettered"))).first()
        if plain:
            asked = asked.unionByName(ask(df.where(~latin)).withColumn("u", -1 - F.col("u")))
        else:
            df = df.where(latin)
    bits = max(12, (MAP_SHARE * count).bit_length())

    # every text as rows of its tokens; contexts only where a trigram that is asked for can stand
    at = F.col("at")
    stream = _fence(df.where(df[text_col].isNotNull()).select(tokens(df[text_col]).alias("t")))
    rows = stream.select("t", F.posexplode("t").alias("at", "w")).where(~F.col("w").isin("", "¶")).select("t", "at", _begun(at).alias("begun"))
    if bits <= map_limit:
        rows = rows.join(F.broadcast(_mapped(unsure, "begun", bits)), _set("begun", bits), "left_semi")
    hit = rows.select(F.get("t", at + 1).alias("next"), *[_back(at, k).alias(f"w{k}") for k in range(REACH)]).where("next <> ''")
    # of each place the trigram with its pair, and the longer contexts that are asked for; one shape, so that one exchange
    # serves all counts; a character tells nothing of a word it begins
    emitted = _grams(hit).select((F.col("next") == "¶").alias("end"), "w0", "w1", "w2", F.posexplode(_levels([])).alias("k", "h"))
    first = (F.col("k") == 0) & ~_is_char(F.col("w0"))
    if bits <= map_limit:
        every = unsure.select(F.explode("asks").alias("h"))
        emitted = emitted.join(F.broadcast(_mapped(every, "h", bits + 2)), _set("h", bits + 2), "left").where(first | F.col("word").isNotNull())
    emitted = emitted.select("h", F.when(first, _pair()).alias("pair"), F.when(first, F.col("w0")).alias("w"), F.col("end").cast("bigint").alias("ends"), F.lit(1).cast("bigint").alias("n"))
    # the places where texts in question stop, in the same shape, taken off
    stops = asked.where("seen <> ''")
    if among is not None and bits <= map_limit:
        stops = stops.join(F.broadcast(_mapped(unsure, "begun", bits)), _set("begun", bits), "left_semi")
    stops = stops.select("asks", "part", (F.col("seen") == "¶").cast("bigint").alias("end"), _is_char(F.col("part")).alias("char"))
    stops = stops.select("asks", "part", "end", "char", F.explode(F.when(F.col("char"), F.col("asks")).otherwise(F.slice("asks", 2, len(LEVELS)))).alias("h"))
    third = ~F.col("char") & (F.col("h") == F.get("asks", F.lit(1)))
    emitted = emitted.unionByName(stops.select("h", F.when(third, F.get("asks", F.lit(0))).alias("pair"), F.when(third, F.col("part")).alias("w"), (-F.col("end")).alias("ends"), F.lit(-1).cast("bigint").alias("n")))
    counted = emitted.groupBy("h", "pair", "w").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n")).where("n > 0")
    none = F.lit(None).cast("string")
    counted = counted.select(F.explode(F.array(F.struct("h", none.alias("w")), F.struct(F.col("pair").alias("h"), "w"))).alias("e"), "ends", "n").select("e.*", "ends", "n").where("h is not null")

    # the longest context that is known well enough from other places; a last word that is only the beginning of what
    # follows the same pair elsewhere
    asks = unsure.select("u", "id", "part", F.posexplode("asks").alias("k", "h"))
    known = F.col("w").isNull() & (F.col("n") >= SUPPORT)
    near = asks.join(counted, "h").groupBy("u", "id").agg(
        F.max_by(F.when(known, F.col("ends") / F.col("n")), F.when(known, F.col("k"))).alias("share"),
        F.sum(F.when(F.col("w").startswith(F.col("part")) & (F.col("w") != F.col("part")), F.col("n")).otherwise(0)).alias("longer"),
        F.sum(F.when(F.col("w") == F.col("part"), F.col("n")).otherwise(0)).alias("same"),
    )
    # that it is only a beginning holds whatever the share: in large tables a word misspelt alike ends sentences often enough
    cut = near.where((F.coalesce(F.col("share"), F.lit(1.0)) < ENDS) | (F.col("longer") > 5 * F.col("same")))
    return cut.select("id").unionByName(asked.where("sure").select("id")).distinct().withColumnRenamed("id", id_col)


def share_cut(df: DataFrame, id_col: str = "row_id", text_col: str = "text", by: str = "model") -> DataFrame:
    """(by, rows, cut, share): how often each source truncates; a null source is a source of its own, empty texts count as whole rows."""
    cut = truncated(df, id_col, text_col).withColumn("hit", F.lit(True))
    rows = df.select(id_col, by).join(cut, id_col, "left")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("cut")).withColumn("share", F.col("cut") / F.col("rows"))
