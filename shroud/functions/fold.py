"""Accent folding and case folding as ``translate`` expressions (M1, M2).

The fold is "NFKD, then drop combining marks", restricted to what keeps
character offsets usable: a character whose fold is exactly one character is
mapped to it, a combining mark is deleted, and a character whose fold has
several characters (ligatures, fractions, Hangul syllables) is left as it is.
The existence test needs no offsets: there, such characters and those beyond the
basic plane are spelled out first (:func:`spell_out`), Hangul syllables excepted.
Masking compares full folds and maps matches back to the original characters (:func:`full_fold`, :func:`origins`).
The tables are computed on the driver from ``unicodedata`` (a rule, not a
hand list) and shipped as one ``translate`` literal, so the work is a JVM
per-character lookup with no Python worker.
"""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BMP_LIMIT = 0x10000
LATIN_END = 0x180


def _fold_char(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@functools.lru_cache(maxsize=None)
def fold_tables(limit: int = BMP_LIMIT) -> tuple[str, str]:
    """(source, target) for ``translate``: mapped characters first, then the deleted ones."""
    mapped_src, mapped_dst, deleted = [], [], []
    for cp in range(limit):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        f = _fold_char(c)
        if f == c:
            continue
        if len(f) == 1:
            mapped_src.append(c)
            mapped_dst.append(f)
        elif not f:
            deleted.append(c)
    return "".join(mapped_src) + "".join(deleted), "".join(mapped_dst)


@functools.lru_cache(maxsize=None)
def casefold_tables(limit: int = BMP_LIMIT) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What ``str.casefold`` adds on top of lower-casing, for already-lower characters
    that survive :func:`fold` (the existence test folds first, then case-folds).

    Returns (single-char source, single-char target, multi-char pairs).
    """
    folded_away = set(fold_tables(limit)[0])
    src, dst, multi = [], [], []
    for cp in range(limit):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        if c.lower() != c or c in folded_away:
            continue
        cf = c.casefold()
        if cf == c:
            continue
        if len(cf) == 1:
            src.append(c)
            dst.append(cf)
        else:
            multi.append((c, cf))
    return "".join(src), "".join(dst), tuple(multi)


@functools.lru_cache(maxsize=None)
def spelled_tables() -> tuple[dict[str, str], str, str]:
    """What :func:`fold` leaves as it is though its full fold differs: the map, a regex class of its keys, and a
    much shorter class that holds them all (Latin texts fail it at once)."""
    table = {}
    for cp in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)]:
        f = _fold_char(chr(cp))
        if f != chr(cp) and (len(f) > 1 or cp >= BMP_LIMIT):
            table[chr(cp)] = f
    codes = sorted(map(ord, table))
    near = "".join(rf"\x{{{cp:X}}}" for cp in codes if cp < LATIN_END)
    return table, f"[{_runs(codes)}]", rf"[{near}\x{{{LATIN_END:X}}}-\x{{10FFFF}}]"


def spell_out(c: Column) -> Column:
    """Characters whose full fold has several characters, or that lie beyond the basic plane, as their fold
    (a ligature as its letters, a mathematical letter as the plain one). Other texts come back as they are."""
    table, odd, maybe = spelled_tables()
    spelled = F.from_json(F.lit(json.dumps(table)), "map<string,string>")
    one = lambda x: F.when(x.rlike(odd), F.coalesce(F.try_element_at(spelled, x), x)).otherwise(x)
    return F.when(c.rlike(maybe) & c.rlike(odd), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _runs(codes) -> str:
    """Code points as the inside of a regex class."""
    runs = []
    for cp in sorted(codes):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


@functools.lru_cache(maxsize=None)
def special_class() -> str:
    """A regex class of the characters whose full fold is not what :func:`fold` puts in their place, one for one:
    dropped marks, ligatures, fractions, Hangul, letters beyond the basic plane."""
    src, dst = fold_tables()
    return "[" + _runs({ord(c) for c in src[len(dst):]} | {ord(c) for c in spelled_tables()[0]}) + r"\x{AC00}-\x{D7A3}]"


def _hangul(c: str) -> str:
    """The letters of a Hangul syllable, by the arithmetic of its code point."""
    letters = lambda first, n: "'" + "".join(map(chr, range(first, first + n))) + "'"
    at = f"(ascii({c}) - 44032)"
    return (f"concat(substring({letters(0x1100, 19)}, {at} div 588 + 1, 1), substring({letters(0x1161, 21)}, {at} % 588 div 28 + 1, 1), "
            f"if({at} % 28 > 0, substring({letters(0x11A8, 27)}, {at} % 28, 1), ''))")


def special_folds(name: str) -> Column:
    """Every character's full fold ("NFKD, combining marks dropped") of a column as an array; null where :func:`fold`
    does it all."""
    table, odd, maybe = spelled_tables()
    src, dst = (x.replace("\\", "\\\\").replace("'", "\\'") for x in fold_tables())
    spelled = f"from_json(r'{json.dumps(table)}', 'map<string,string>')"
    return F.expr(f"""if({name} rlike r'{maybe}' and {name} rlike r'{special_class()}', transform(split({name}, ''), x -> case
        when x rlike r'{odd}' then coalesce(try_element_at({spelled}, x), x)
        when x rlike r'[\\x{{AC00}}-\\x{{D7A3}}]' then {_hangul("x")} else translate(x, '{src}', '{dst}') end), null)""")


def full_fold(c: Column, folds: Column) -> Column:
    """The full fold of a text, ``folds`` being its :func:`special_folds`."""
    return F.coalesce(F.array_join(folds, ""), fold(c))


def origins(folds: str) -> Column:
    """For every character of a full fold the 0-based position it comes from; null where that is its own."""
    return F.expr(f"flatten(transform({folds}, (f, i) -> array_repeat(i, length(f))))")


def fold(c: Column) -> Column:
    """Accent fold (M1): case kept, offsets kept except where combining marks are dropped."""
    src, dst = fold_tables()
    return F.translate(c, src, dst)


def casefold(c: Column) -> Column:
    """Python ``str.casefold`` on folded text: ``lower`` plus the extra full foldings (ß -> ss, ...)."""
    src, dst, multi = casefold_tables()
    out = F.translate(F.lower(c), src, dst)
    for a, b in multi:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def match_key(c: Column, case_insensitive: bool = True, normalize: bool = True) -> Column:
    """The comparison form of a text for the existence test (M2).

    No ASCII character is in the fold or case-fold tables, so an ASCII-only
    text skips them: its key is ``lower`` alone (about twice as fast on
    tokens, same result).
    """
    if case_insensitive and normalize:
        return F.when(c.rlike(r"^[\x00-\x7f]*$"), F.lower(c)).otherwise(casefold(fold(spell_out(c))))
    if normalize:
        c = fold(spell_out(c))
    if case_insensitive:
        c = casefold(c)
    return c


def python_fold(s: str) -> str:
    """Driver-side equivalent of :func:`fold` (for tests and small fixtures)."""
    src, dst = fold_tables()
    table = {ord(a): b for a, b in zip(src, dst)}
    table.update({ord(a): None for a in src[len(dst):]})
    return s.translate(table)


@functools.lru_cache(maxsize=1)
def _python_tables() -> tuple[dict, dict, dict, tuple]:
    src, dst = fold_tables()
    folded = {ord(a): b for a, b in zip(src, dst)} | {ord(a): None for a in src[len(dst):]}
    lower_src, lower_dst, multi = casefold_tables()
    return {ord(k): v for k, v in spelled_tables()[0].items()}, folded, {ord(a): b for a, b in zip(lower_src, lower_dst)}, multi


def python_match_key(s: str) -> str:
    """:func:`match_key` (folded, case-folded) of one string, for tasks that compare many short ones."""
    if s.isascii():
        return s.lower()
    spelled, folded, lowered, multi = _python_tables()
    out = s.translate(spelled).translate(folded).lower().translate(lowered)
    for a, b in multi:
        out = out.replace(a, b)
    return out
