"""One consistent form for texts that look the same (problem 5).

A batch of texts is exploded into positioned code points (row, position, code
point) held in flat numpy arrays.  Decomposition and look-alike mappings are
small tables built by rule and present on every worker, so the join with them
is an array lookup and nothing is shuffled.  Combining marks are then ordered by
their class, recomposed with their base, and the strings are rebuilt.

Defined results: null stays null, empty stays empty, line feeds stay (carriage
returns before them go), so line numbers never change.  Case, accents, digits and
visible marks are kept.
"""

from __future__ import annotations

import functools
import sys
import unicodedata as ud
from collections.abc import Iterable

import numpy as np

# Letters of other scripts that are drawn like a Latin letter.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M",
    "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y",
    "Ԛ": "Q", "Ԝ": "W", "У": "Y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "α": "a", "υ": "u", "ι": "i",
    # Latin extensions and Armenian
    "ɑ": "a", "ɡ": "g", "ı": "i", "օ": "o",
}

# Compatibility tags whose characters look like their decomposition.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}

INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x200B, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
LF, CR, SPACE = 10, 13, 32
CHUNK_CHARS = 400_000  # code points handled at once; bounds a worker's memory


def _expand(cp: int) -> list[int]:
    """What a code point stands for, decomposed as far as it looks the same."""
    ch = chr(cp)
    if cp == LF:
        return [LF]
    if cp in INVISIBLE:
        return []
    cat = ud.category(ch)
    if cat == "Cf" or (cat == "Cc" and cp not in (9, 11, 12)):
        return []
    if cat in ("Zs", "Zl", "Zp") or cp in (9, 11, 12):
        return [SPACE]
    if ch in LOOK_ALIKES:
        return [ord(LOOK_ALIKES[ch])]
    parts = ud.decomposition(ch).split()
    if not parts or (parts[0][0] == "<" and parts[0] not in SAME_LOOK):
        return [cp]
    return [y for x in parts if x[0] != "<" for y in _expand(int(x, 16))]


@functools.cache
def tables():
    """Index arrays: number and place of each code point's expansion, combining classes, and pairs that compose."""
    n = sys.maxunicode + 1
    size, place, flat = np.ones(n, np.uint8), np.zeros(n, np.int32), [0]
    changed, ccc = np.zeros(n, bool), np.zeros(n, np.uint8)
    pairs = {}
    ideographs = [(0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xF900), (0x17000, 0x1B000), (0x20000, 0x2F800), (0x30000, 0xE0000), (0xE0200, n)]
    plain = np.ones(n, bool)
    for a, b in ideographs:  # no mappings there; Hangul syllables stay composed
        plain[a:b] = False
    for cp in np.flatnonzero(plain).tolist():
        to = _expand(cp)
        ccc[cp] = ud.combining(chr(cp))
        if to != [cp]:
            changed[cp], size[cp], place[cp] = True, len(to), len(flat)
            flat += to
        canon = ud.decomposition(chr(cp)).split()
        if len(canon) == 2 and canon[0][0] != "<" and ud.normalize("NFC", chr(cp)) == chr(cp):
            pairs[int(canon[0], 16) << 21 | int(canon[1], 16)] = cp
    for lead in range(19):  # Hangul by its rule
        for vowel in range(21):
            lv = 0xAC00 + (lead * 21 + vowel) * 28
            pairs[(0x1100 + lead) << 21 | 0x1161 + vowel] = lv
            for tail in range(1, 28):
                pairs[lv << 21 | 0x11A7 + tail] = lv + tail
    keys = np.array(sorted(pairs), np.int64)
    second = np.zeros(n, bool)
    second[keys & 0x1FFFFF] = True
    return changed, size, place, np.array(flat, np.uint32), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32), second


def _compose(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, _, _, ccc, keys, to, second = tables()
    cl = ccc[cp]
    if cl.any():  # canonical order: marks after their base by class, else as they stand
        seg = np.cumsum(cl == 0)
        order = np.lexsort((np.arange(len(cp)), cl, seg, row))
        cp, row = cp[order], row[order]
    for _ in range(8):  # each pass joins one mark to its base
        cand = np.flatnonzero(second[cp[1:]] & (row[1:] == row[:-1]))
        if not len(cand):
            break
        k = cp[cand].astype(np.int64) << 21 | cp[cand + 1]
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        ok = keys[at] == k
        cand, at = cand[ok], at[ok]
        if len(cand) > 1:  # of overlapping pairs the first composes in this pass
            free = np.ones(len(cand), bool)
            for i in np.flatnonzero(np.diff(cand) == 1).tolist():
                free[i + 1] = not free[i]
            cand, at = cand[free], at[free]
        if not len(cand):
            break
        cp = cp.copy()
        cp[cand] = to[at]
        keep = np.ones(len(cp), bool)
        keep[cand + 1] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def _forms(texts: list[str]) -> list[str]:
    changed, size, place, flat, ccc, *_, second = tables()
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    odd = changed[cp] | second[cp] | (ccc[cp] > 0)
    total = np.concatenate(([0], np.cumsum(odd)))
    dirty = np.flatnonzero(total[ends] > total[ends - lens])
    if not len(dirty):
        return texts
    take = np.zeros(len(texts), bool)
    take[dirty] = True
    mask = np.repeat(take, lens)
    cp, row = cp[mask], np.repeat(np.arange(len(texts), dtype=np.int32), lens)[mask]
    ch = changed[cp]
    n = np.where(ch, size[cp], 1).astype(np.int64)
    start = np.cumsum(n) - n
    out_row = np.repeat(row, n)
    within = np.arange(len(out_row)) - np.repeat(start, n)
    src = np.repeat(cp, n)
    out = np.where(np.repeat(ch, n), flat[np.repeat(place[cp], n) + within * np.repeat(ch, n)], src)
    out, out_row = _compose(out, out_row)
    text = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    cuts = np.searchsorted(out_row, np.arange(len(texts) + 1))
    result = list(texts)
    for i in dirty.tolist():
        result[i] = text[cuts[i] : cuts[i + 1]]
    marks = ccc[out] > 0
    stacked = out_row[1:][marks[1:] & marks[:-1] & (out_row[1:] == out_row[:-1])]
    for i in np.unique(stacked).tolist():  # a mark may join its base over other marks; such stacks are rare
        result[i] = ud.normalize("NFC", result[i])
    return result


def consistent_forms(texts: Iterable[str | None]) -> list[str | None]:
    """The consistent form of each text, in order."""
    texts = list(texts)
    out: list[str | None] = [None] * len(texts)
    at: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for i, x in zip(at, _forms([texts[i] for i in at])):
            out[i] = x
        at.clear()
        held = 0

    for i, x in enumerate(texts):
        if not x:
            out[i] = x
            continue
        at.append(i)
        held += len(x)
        if held >= CHUNK_CHARS:
            flush()
    if at:
        flush()
    return out
