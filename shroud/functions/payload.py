"""Item schema and the JSON payload gate.

A detector (rules, dictionary, or a user function such as a model client)
answers per chunk with a JSON array of items. These helpers turn that text
into ``ARRAY<STRUCT<text, category, type, justification>>`` with native
``from_json``; malformed answers become null instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.functions.text import py_strip

ITEM = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("justification", T.StringType()),
    ]
)
ITEMS = T.ArrayType(ITEM)
ITEM_FIELDS = ("text", "category", "type", "justification")

# The fence a detector wraps its JSON answer in.
FENCE_OPEN = "```json\n"
FENCE_CLOSE = "\n```"
# JSON insignificant whitespace (RFC 8259).
_JSON_WS = r"[ \t\n\r]"


def strip_fence(c: Column, require: bool = True) -> Column:
    """Remove the outer ```json fence and strip.

    With ``require`` an unfenced answer gives null (detect step); without it
    the answer is used as it is (combine step).
    """
    fenced = c.startswith(FENCE_OPEN) & c.endswith(FENCE_CLOSE) & (F.length(c) >= len(FENCE_OPEN) + len(FENCE_CLOSE))
    inner = py_strip(F.substring(c, len(FENCE_OPEN) + 1, F.length(c) - len(FENCE_OPEN) - len(FENCE_CLOSE)))
    if require:
        return F.when(fenced, inner)
    return F.when(fenced, inner).otherwise(c)


def parse_items(c: Column) -> Column:
    """The items of an answer that is one non-empty JSON array of item objects, else null.

    ``from_json`` alone accepts a lone object as a one-element array and
    ignores what follows the first value. So the text is read inside ``[ ]``
    and inside ``{"x": }``: what may follow the first value unnoticed in one
    (a ``]`` or a ``}`` that closes the wrapping) breaks the other, and a
    second value after a comma gives the outer array a second entry.
    """
    shaped = c.rlike(r"(?s)^" + _JSON_WS + r"*\[.*\]" + _JSON_WS + r"*\z")
    strict = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
    listed = F.from_json(F.concat(F.lit("["), c, F.lit("]")), T.ArrayType(ITEMS), strict)
    keyed = F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), T.StructType([T.StructField("x", ITEMS)]), strict)["x"]
    items = F.get(listed, F.lit(0))
    return F.when(shaped & (F.size(listed) == 1) & (F.size(items) > 0) & keyed.isNotNull(), items)


def reject_reason(c: Column, require_fence: bool = True) -> Column:
    """Why an answer gives no items; null for a good answer and for an empty list (nothing found)."""
    body = strip_fence(c, require_fence)
    shaped = body.rlike(r"(?s)^" + _JSON_WS + r"*\[.*\]" + _JSON_WS + r"*\z")
    empty = body.rlike(r"^" + _JSON_WS + r"*\[" + _JSON_WS + r"*\]" + _JSON_WS + r"*\z")
    return (F.when(c.isNull(), "no answer").when(body.isNull(), "no fence").when(~shaped, "not a JSON array")
            .when(~empty & parse_items(body).isNull(), "invalid JSON"))


def item_struct(text: Column, category: Column, type_: Column, justification: Column) -> Column:
    return F.struct(
        text.alias("text"), category.alias("category"), type_.alias("type"), justification.alias("justification")
    )


def items_json(items: Column) -> Column:
    """Serialise an item array the way a detector would answer."""
    return F.to_json(items)


def fenced(c: Column) -> Column:
    return F.concat(F.lit(FENCE_OPEN), c, F.lit(FENCE_CLOSE))
