"""Sentence units of a text in any language, script and layout (problem 8).

A pushdown automaton reads the marks of a text.  Its stack holds the open
quotations and brackets, its registers the list level and the start of the unit.
Abbreviations are looked up backwards in a trie, terminators belong to scripts.
Everything is in code points; the operator maps over partitions and shuffles
nothing, so it scales with the number of files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lexweave.llm.common import spread

# Abbreviations that never end a sentence (titles, references, connectives).
NEVER_FINAL = """
mr mrs ms dr prof st lt sgt capt col gen rev hon messrs no nos fig figs vol pp cf e.g i.e approx vs viz ed eds
hr fr nr abs bd abb bzw ca evtl ggf inkl vgl z.b d.h u.a sog str dipl ing
m mm mme mlle mgr env art chap tél c.-à-d p.ex
sr sra srta dra d.ª ej pág págs cap avda ud uds aprox núm
sig sig.ra sig.na dott avv ing on es ecc.a sec pag cap fig prof.ssa
profa séc av tel ex
г-н г-жа проф ул стр рис см им акад доц д кв т.е напр ок гл пр
د س ص أ ج م
डॉ प्रो श्री रु पृ सं कु
ดร นาย ผศ รศ ศ พ.ศ ค.ศ น
"""
# Abbreviations that may end one; the next word decides.
MAYBE_FINAL = "a.m p.m etc inc ltd co corp jr sr. bros dept u.s u.k jh usw u.ä ecc etc. г гг в вв руб тыс млн т.п т.д др"
MONTHS = set(
    "januar februar märz april mai juni juli august september oktober november dezember jh jahrhundert "
    "jahrhunderts jahrhunderte".split()
)
ORDINAL_BEFORE = set("am dem den der vom zum im des beim seit das die bis ab jeden".split())
#: Words that carry a sentence on after an abbreviation, for texts that have lost their letter case.
GO_ON = set("on and or y und oder im am et et и или".split())

MARKS = ".!?…。！？।॥؟۔｡．"
CJK_MARKS = set("。！？｡．")
PAIRS = {"«": "»", "(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "［": "］"}
QUOTES = set("«“„\"「『")
CLOSERS = set("»”“\"'’)]}）」』》〉】］*_")
OPENERS = set("«“„\"'‘([{（「『《〈【［¿¡")
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "

_BLANK = re.compile(r"(?>\r\n|[\n\r\x0b\x0c\x85 ])[^\S\r\n]*(?>\r\n|[\n\r\x0b\x0c\x85 ])\s*| \s*")
_STACKED = re.compile("[«»“”„\"()\\[\\]{}（）「」『』《》〈〉【】［］]")
_EVENT = re.compile(
    f"(?P<mark>[{MARKS}]+(?:[^\\S{BREAKS}]?[!?…]+)*)"
    f"|(?P<line>[^\\S{BREAKS}]*(?:\r\n|[{BREAKS}])\\s*)"
    "|(?P<thai>(?<=[ก-๎\"”»)])[ \t\xa0　]+(?=\\S))"
)
_TOKEN = re.compile(r"[^\s\"“”„«»()\[\]—–,;:¿¡…/（「『《]*$")
_WORD = re.compile(r"[^\W\d_]+")
_LIST = re.compile(r"(?:[-*•·‣▪●○◦–+]|\d{1,3}[.)]|\(\d{1,3}\))[ \t\xa0　]+")
_BULLET = re.compile(r"[-*•·‣▪●○◦][ \t\xa0　]+")
_LOWER, _UPPER = re.compile(r"[a-zà-öø-ÿа-яё]"), re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ]")
_LATIN3 = re.compile(r"[A-Za-zÀ-ÿ]+[^฀-๿]*\s[A-Za-zÀ-ÿ]+[^฀-๿]*\s[A-Za-zÀ-ÿ]+")


def _trie(words: str, kind: int, root: dict) -> dict:
    for w in words.split():
        node = root
        for ch in reversed(w):
            node = node.setdefault(ch, {})
        node[""] = kind
    return root


#: Read from the point backwards; "" marks the beginning of an abbreviation (1 never final, 2 perhaps final).
TRIE = _trie(MAYBE_FINAL, 2, _trie(NEVER_FINAL, 1, {}))


def abbreviation(s: str, end: int, start: int) -> int:
    """0, 1 (never final) or 2 (perhaps final): the abbreviation that stands in s before the point at ``end``."""
    node, i, kind = TRIE, end - 1, 0
    while True:
        if "" in node and (i < start or not (s[i].isalnum() or s[i] == ".")):
            kind = node[""]
        if i < start:
            return kind
        ch = s[i]
        nxt = node.get(ch) or node.get(ch.lower())
        if nxt is None:
            # a gap inside an abbreviation of several parts ("p. ex", "т. е")
            if ch.isspace():
                while i > start and s[i].isspace():
                    i -= 1
                if s[i] == "." and "." in node:
                    node, i = node["."], i - 1
                    continue
            return kind
        node, i = nxt, i - 1


def _pairs(s: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets of a paragraph; what never closes is no nesting."""
    stack: list[tuple[str, int]] = []
    done: list[tuple[int, int]] = []
    for m in _STACKED.finditer(s, lo, hi):
        ch, i = m.group(), m.start()
        if ch == '"':
            want = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), -1)
            before = s[i - 1] if i > lo else " "
            if want < 0:
                if i + 1 < hi and not s[i + 1].isspace() and not (before.isdigit() and not s[i + 1].isalpha()):
                    stack.append(('"', i))
                continue
        elif ch in PAIRS:
            stack.append((PAIRS[ch], i))
            continue
        elif ch == "„":
            stack.append(("“", i))
            continue
        elif ch == "“":
            want = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "“"), -1)
            if want < 0:
                stack.append(("”", i))
                continue
        else:
            want = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == ch or ch == "”" and stack[k][0] == "“"), -1)
        if want >= 0:
            done.append((stack[want][1], i))
            del stack[want:]
    done.sort()
    top: list[tuple[int, int]] = []
    for o, c in done:
        if not top or o > top[-1][1]:
            top.append((o, c))
    return top


def _case(ch: str) -> str:
    """l, u, c (letter without case), d (digit) or s (symbol)."""
    if ch.isalpha():
        return "l" if ch.islower() else "u" if ch.isupper() else "c"
    return "d" if ch.isdigit() else "s"


def _next(s: str, i: int, hi: int) -> tuple[int, str]:
    """Where the next letter or digit stands, past quotes, brackets, dashes and inverted marks; its case."""
    n = 0
    while i < hi and n < 12:
        k = _case(s[i])
        if k != "s":
            return i, k
        if not (s[i] in OPENERS or s[i] in "—–-" or s[i].isspace()):
            return i, "s"
        i, n = i + 1, n + 1
    return i, "s"


def units(text: str | None, most: int = 0) -> list[tuple[int, int]]:
    """Half-open ranges of the sentence units of a text, or of its first ``most``; none for a null or blank text."""
    if not text or text.isspace():
        return []
    n = len(text)
    flat = not (_LOWER.search(text) and _UPPER.search(text)) and bool(_LOWER.search(text) or _UPPER.search(text))
    out: list[tuple[int, int]] = []
    lo = 0
    for m in _BLANK.finditer(text):
        _paragraph(text, lo, m.start(), flat, out, most)
        if most and len(out) >= most:
            return out[:most]
        lo = m.end()
    _paragraph(text, lo, n, flat, out, most)
    return out[:most] if most else out


def _emit(s: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    while a < b and s[a].isspace():
        a += 1
    while b > a and s[b - 1].isspace():
        b -= 1
    if a < b:
        out.append((a, b))


def _paragraph(s: str, lo: int, hi: int, flat: bool, out: list[tuple[int, int]], most: int = 0) -> None:
    while lo < hi and s[lo].isspace():
        lo += 1
    if lo >= hi:
        return
    spans = _pairs(s, lo, hi)
    at, ns, start, pos = 0, len(spans), lo, lo
    listed = bool(_LIST.match(s, lo, hi))
    while not most or len(out) < most:
        stop = spans[at][0] if at < ns else hi
        m = _EVENT.search(s, pos, hi)
        if at < ns and (m is None or m.start() >= stop):
            o, c = spans[at]
            at, pos = at + 1, c + 1
            if _after_span(s, o, c, start, hi, flat):
                _emit(s, start, pos, out)
                start = pos
            continue
        if m is None:
            break
        if m.group("mark"):
            i, j = m.span()
            e = j
            while e < hi and (s[e] in CLOSERS and not (at < ns and spans[at][0] == e)):
                if s[e] == '"' and e + 1 < hi and not s[e + 1].isspace() and s[e + 1] not in MARKS:
                    break
                e += 1
            if e < hi and e > j and s[e] in MARKS:
                e = j
            pos = e
            if _after_mark(s, i, j, e, start, lo, hi, flat):
                _emit(s, start, e, out)
                start = e
                k = e
                while k < hi and s[k].isspace():
                    k += 1
                if k < hi and any(ch in BREAKS for ch in s[e:k]):
                    listed = bool(_LIST.match(s, k, hi))
                elif k < hi and listed is True and e < k:
                    listed = False
        elif m.group("line"):
            k = pos = m.end()
            new = bool(_BULLET.match(s, k, hi)) or listed and bool(_LIST.match(s, k, hi))
            if not new and listed:
                new = k < hi and _case(s[k]) != "l"
            if not new and _thai(s, m.start(), k, hi):
                new = True
            if new and m.start() > start:
                _emit(s, start, k, out)
                start = k
                listed = bool(_LIST.match(s, k, hi))
        else:
            pos = m.end()
            if _thai(s, m.start(), m.end(), hi):
                _emit(s, start, pos, out)
                start = pos
    _emit(s, start, hi, out)


def _thai(s: str, i: int, k: int, hi: int) -> bool:
    """Does the space s[i:k] part two statements in a script without end marks?"""
    left = i - 1
    while left > 0 and s[left] in CLOSERS:
        left -= 1
    if k >= hi or not "ก" <= s[left] <= "๎" and not (s[left] in MARKS and left > 0 and "ก" <= s[left - 1] <= "๎"):
        return False
    r = k
    while r < hi and s[r] in OPENERS:
        r += 1
    if r >= hi or s[r].isdigit():
        return False
    if "ก" <= s[r] <= "๎":
        return True
    return s[r].isalpha() and (not ("A" <= s[r] <= "ɏ") or bool(_LATIN3.match(s, r, min(hi, r + 120))))


def _after_span(s: str, o: int, c: int, start: int, hi: int, flat: bool) -> bool:
    """Does a unit end with the quotation or bracket s[o:c+1]?"""
    k = c - 1
    while k > o and (s[k] in CLOSERS or s[k].isspace()):
        k -= 1
    if s[k] not in MARKS:
        return False
    j = c + 1
    while j < hi and s[j].isspace():
        j += 1
    if j >= hi:
        return False
    if s[j] in MARKS or s[j] in ",;:，、；：،؛":
        return False
    where, kind = _next(s, j, hi)
    lead = o - 1
    while lead >= start and s[lead].isspace():
        lead -= 1
    intro = lead >= start and s[lead] in ":：,，、،"
    if kind == "s":
        return False
    if s[o] not in QUOTES:
        return lead < start and kind in "uc" and s[k] not in "…" and j > c + 1
    if s[j] in "—–-" and kind != "u":
        return False
    if kind == "l" and not flat:
        return False
    if kind in "cl" or flat:
        return intro
    return True


def _after_mark(s: str, i: int, j: int, e: int, start: int, lo: int, hi: int, flat: bool) -> bool:
    """Does a unit end with the mark s[i:j] and the closing signs s[j:e]?"""
    run = s[i:j]
    k = e
    while k < hi and s[k].isspace():
        k += 1
    if k >= hi:
        return False
    gap = k > e
    broke = gap and any(ch in BREAKS for ch in s[e:k])
    first = run[0]
    dots = all(ch in ".…" or ch.isspace() for ch in run) and (len(run) > 1 or run == "…")
    if not gap and s[k] in ",;:，、；：،؛)":
        return False
    if first in CJK_MARKS and not dots:
        return not (first == "．" and s[k].isdigit())
    if first in "।॥":
        return True
    where, kind = _next(s, k, hi)
    if dots:
        if kind == "u" and not flat:
            return gap
        if kind == "s" and broke:
            return True
        if flat and kind in "lu":
            return gap and len(_WORD.findall(s, start, i)) > 2
        return kind == "c" and gap and _case(s[i - 1]) in "lu"
    if run == ".":
        t = _TOKEN.search(s, max(start, i - 40), i)
        token = t.group() if t else ""
        if not gap:
            if kind == "d" or "/" in token or "@" in token or "." in token:
                return False
            if where > k and s[k] not in OPENERS:
                return False
            if kind == "u":
                return len(token) > 1 and (token[-1].islower() or where > k) and abbreviation(s, i, start) != 1 or len(token) > 1 and token[-1].isdigit() and where == k and k + 1 < hi and s[k + 1].islower()
            if kind == "c":
                thai = "ก" <= s[where] <= "๎"
                return not thai and len(token) > 2 and not abbreviation(s, i, start) and not token.isascii()
            return False
        if token and _LIST.match(s, i - len(token), hi) and i - len(token) == start and token.isdigit():
            return False
        kindof = abbreviation(s, i, start)
        if kindof == 1:
            return False
        last = token.rsplit("-", 1)[-1]
        if len(last) == 1 and last.isalpha() and not "฀" <= last <= "๿" and not last > "⺀":
            return False
        if kind == "s":
            return broke
        nxt = _WORD.match(s, where)
        word = nxt.group().lower() if nxt else ""
        if kind == "l":
            return flat and not (kindof == 2 and word in GO_ON) and not (token.isdigit() and len(token) < 3 and word in MONTHS) and not token.replace(".", "").isdigit() or flat and token.isdigit() and word not in MONTHS
        if kindof == 2 and flat and word in GO_ON:
            return False
        if token.isdigit() and len(token) <= 2 and kind == "u":
            before = re.search(r"([^\W\d_]+)\s+$", s[max(lo, i - len(token) - 20) : i - len(token)])
            if word in MONTHS or before and before.group(1).lower() in ORDINAL_BEFORE:
                return False
        if kind == "c" and len(token) <= 3 and "ऀ" <= (token or " ")[-1] <= "ॿ":
            return False
        return True
    # ! ? and their kin
    if kind == "s":
        return broke
    if kind == "l":
        return flat and gap
    if not gap:
        return kind in "uc"
    return True


def _map_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids: list[int] = []
        a: list[int] = []
        b: list[int] = []
        for key, text in zip(pdf.iloc[:, 0].tolist(), pdf.iloc[:, 1].tolist()):
            for lo, hi in units(text):
                ids.append(key)
                a.append(lo)
                b.append(hi)
        yield pd.DataFrame({"key": pd.Series(ids, dtype="int64"), "start_pos": pd.Series(a, dtype="int32"), "end_pos": pd.Series(b, dtype="int32")})


def sentence_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_pos, end_pos) of every unit.

    Null ids are left out, null and blank texts give no row, repeated rows give
    their units again, an empty table gives an empty result; other columns are not read.
    """
    src = df.select(df[id_col].cast("bigint").alias("key"), df[text_col].cast("string").alias("text")).where("key is not null and text is not null")
    got = spread(src).mapInPandas(_map_units, "key bigint, start_pos int, end_pos int")
    return got.withColumnRenamed("key", id_col)
