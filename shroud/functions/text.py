"""Text cleaning as native Spark column expressions.

Every step is a JVM string function (``regexp_replace``, ``split``,
``transform``) so cleaning stays inside the scan stage: no Python worker, no
shuffle. Order of the steps is part of the semantics.

Regex dialect notes. Python's ``\\s`` and ``str.splitlines``/``rstrip`` are
Unicode-aware and include U+001C-U+001F; Java's ``\\s`` is ASCII. The classes
below spell the Python sets out so Java (Spark) and RE2 (the DuckDB oracle)
agree with Python character for character.
"""

from __future__ import annotations

import functools
import html
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of Python's str.isspace, its line-boundary
# subset (str.splitlines), and the rest (what rstrip removes inside a line).
PY_SPACE = (
    r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
INLINE_SPACE = r"\t\x{1f} \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"

# The cleaning patterns, in the order they are applied.
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_TAG = r"<[^>]+>"
SPACE_RUN = r" {2,}"  # same result as " +" -> " ", without rewriting single spaces
NEWLINE_RUN = r"\n{3,}"
BROKEN_LABEL = r"([a-zA-Zα-ωΑ-Ω])\.[" + PY_SPACE + r"]+:"
SPACE_BEFORE_PUNCT = r" ([.,:])"
TRAILING_INLINE_SPACE = r"[" + INLINE_SPACE + r"]+(\n|\z)"

# Numeric character references: grammar of the HTML5 tokenizer as Python's
# html.unescape implements it.
_CHARREF_BODY = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@functools.lru_cache(maxsize=None)
def _tables_json() -> tuple[str, str, str]:
    """JSON texts of the entity table, the legacy (no ';') names and the numeric exceptions.

    Shipped as one string literal each and parsed by ``from_json``, which the
    optimizer folds to a constant: building a 2,231-entry literal element by
    element from Python is slow.
    """
    table = html.entities.html5
    legacy = sorted((k for k in table if not k.endswith(";")), key=lambda k: (-len(k), k))
    exc = {str(k): v for k, v in _numeric_exceptions().items()}
    return json.dumps(table), json.dumps(legacy), json.dumps(exc)


def _numeric_exceptions() -> dict[int, str]:
    """Code points whose reference decodes to something other than chr(n).

    Derived from the stdlib decoder itself over the ranges the HTML5 spec
    singles out (C0/C1 controls, noncharacters), so the table follows Python.
    """
    probe = list(range(0, 0xA0)) + list(range(0xFDD0, 0xFDF0))
    probe += [p * 0x10000 + 0xFFFE for p in range(17)] + [p * 0x10000 + 0xFFFF for p in range(17)]
    out = {}
    for n in probe:
        got = html.unescape(f"&#{n};")
        if got != chr(n):
            out[n] = got
    return out


def _codepoint_to_string(num: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(num), 8, "0")), "UTF-32")


def _decode_piece(x: Column) -> Column:
    """Decode the character reference heading piece ``x.p``; ``x.ref`` is its extracted name."""
    named_json, legacy_json, exc_json = _tables_json()
    named = F.from_json(F.lit(named_json), "map<string,string>")
    legacy_arr = F.from_json(F.lit(legacy_json), "array<string>")
    exc_map = F.from_json(F.lit(exc_json), "map<string,string>")

    p, ref = x["p"], x["ref"]
    rest = F.substring(p, F.length(ref) + 2, 1 << 30)

    dec_digits = F.regexp_extract(ref, r"^#0*([0-9]+)", 1)
    hex_digits = F.regexp_extract(ref, r"^#[xX]0*([0-9a-fA-F]+)", 1)
    is_hex = ref.rlike(r"^#[xX]")
    too_big = F.when(is_hex, F.length(hex_digits) > 6).otherwise(F.length(dec_digits) > 7)
    num = F.when(is_hex, F.conv(hex_digits, 16, 10)).otherwise(dec_digits).try_cast("bigint")
    numeric = (
        F.when(too_big | (num > 0x10FFFF) | num.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(F.try_element_at(exc_map, num.cast("string")).isNotNull(), F.try_element_at(exc_map, num.cast("string")))
        .otherwise(_codepoint_to_string(num))
    )

    direct = F.try_element_at(named, ref)
    prefix = F.try_element_at(
        F.filter(legacy_arr, lambda n: ref.startswith(n) & (F.length(n) < F.length(ref))), F.lit(1)
    )
    by_prefix = F.when(
        prefix.isNotNull(), F.concat(F.try_element_at(named, prefix), F.substring(ref, F.length(prefix) + 1, 64))
    ).otherwise(F.concat(F.lit("&"), ref))
    named_value = F.when(direct.isNotNull(), direct).otherwise(by_prefix)
    decoded = F.when(ref.startswith("#"), numeric).otherwise(named_value)
    return F.when(ref == "", p).otherwise(F.concat(decoded, rest))


def unescape_html(c: Column) -> Column:
    """Single-pass HTML entity decoding, equal to Python's ``html.unescape``.

    Splits before every '&', decodes the reference heading each piece through
    the HTML5 entity table (a map literal built from the stdlib table), and
    re-joins. The reference name of a piece is extracted once (a struct field),
    not once per use, and ``c`` is referenced once so an upstream expression
    is not evaluated twice (higher-order functions run interpreted).
    """
    def piece(p, i):
        whole = F.when(i == 0, p).otherwise(F.concat(F.lit("&"), p))
        ref = F.when(i == 0, F.lit("")).otherwise(F.regexp_extract(p, _CHARREF_BODY, 1))
        return F.struct(whole.alias("p"), ref.alias("ref"))

    # split on the literal '&' (no regex look-ahead); piece i > 0 followed an '&'
    pieces = F.transform(F.split(c, "&"), piece)
    return F.array_join(F.transform(pieces, _decode_piece), "")


def normalize_line_ends(c: Column) -> Column:
    """``'\\n'.join(l.rstrip() for l in s.splitlines())`` as three replaces."""
    c = F.regexp_replace(c, LINE_BREAK, "\n")
    c = F.regexp_replace(c, r"\n\z", "")
    return F.regexp_replace(c, TRAILING_INLINE_SPACE, "$1")


def clean_text(c: Column) -> Column:
    """Markup and layout clean-up of one text column (C1-C10). Null -> ''."""
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(c, HTML_COMMENT, "")
    c = F.regexp_replace(c, HTML_COMMENT, "")  # a second pass removes comments nested in broken ones
    c = F.regexp_replace(c, HTML_TAG, "")
    c = unescape_html(c)
    c = F.regexp_replace(c, SPACE_RUN, " ")
    c = F.regexp_replace(c, NEWLINE_RUN, "\n\n")
    c = F.regexp_replace(c, BROKEN_LABEL, "$1.:")
    c = F.regexp_replace(c, SPACE_BEFORE_PUNCT, "$1")
    return normalize_line_ends(c)


def has_visible_char(c: Column) -> Column:
    """True when the text holds a character Python's ``str.strip`` would keep (K6)."""
    return c.rlike(r"[^" + PY_SPACE + r"]")


# The same whitespace set as characters, for trim().
PY_SPACE_CHARS = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` with its Unicode whitespace set (``trim`` with that character set)."""
    return F.trim(c, F.lit(PY_SPACE_CHARS))


def tidy_chunk(c: Column) -> Column:
    """Per-chunk tidy-up after splitting (K3): strip, then newline runs -> one space."""
    return F.regexp_replace(py_strip(c), r"\n+", " ")
