"""Detectors: chunk rows in, item rows out.

Output schema of every detector (``DETECTIONS``): one row per found item,
``doc_id, chunk_index, round, item_pos, text, category, type,
justification``. ``(round, chunk_index, item_pos)`` is the order key that
"first occurrence wins" de-duplication uses later.

* ``detect_rules``: every rule is a ``regexp_extract_all``; all rules of a
  chunk are concatenated into one array and exploded once, so the scan runs
  once whatever the number of rules.
* ``detect_dictionary``: a term table of measured size goes to the tasks as a
  trie of folded, case-folded tokens, and only matches become rows; a larger one
  is equi-joined to the chunks' tokens (AQE splits a hot token's partition).
* ``detect_with``: a caller's function (for instance a model client) applied
  to Arrow batches of chunk texts by ``mapInPandas``; its raw answers go
  through the JSON gate of :mod:`shroud.functions.payload`.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from typing import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.functions.fold import match_key, python_match_key
from shroud.functions.text import PY_SPACE
from shroud.functions.payload import reject_reason, item_struct, parse_items, strip_fence
from shroud.session import ship_package

DETECTIONS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("round", T.IntegerType()),
        T.StructField("item_pos", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("justification", T.StringType()),
    ]
)
DETECTION_COLS = [f.name for f in DETECTIONS.fields]

# item_pos of detector k starts at k * POS_STRIDE when detectors are combined.
POS_STRIDE = 1_000_000_000

_WORD = "[0-9A-Za-z_]"
# ASCII word boundary (what RE2's \b means) for Java, whose \b is Unicode-aware.
JAVA_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


@dataclass(frozen=True)
class Rule:
    r"""One detection rule.

    ``pattern`` is RE2/Python syntax (``\b`` = ASCII word boundary) and is what
    the SQL oracle runs. ``java`` is an equivalent Java form tuned for the
    regex engine: a boundary next to a word character becomes a one-sided
    look-around, checked after the first character so most positions fail on
    one class test. ``needs`` is a literal every match contains; chunks
    without it skip the rule. ``check`` names an extra validation of each
    match (``"luhn"`` for card numbers, ``"octets"`` for IPv4 addresses).
    """

    category: str
    type: str
    pattern: str
    justification: str
    java: str | None = None
    needs: str | None = None
    check: str | None = None

    @property
    def java_pattern(self) -> str:
        return self.java or self.pattern.replace(r"\b", JAVA_BOUNDARY)


_NW = f"(?!{_WORD})"


def _lead(first: str) -> str:
    r"""``\b`` + one character of class ``first``, for Java: the class, then a look-behind."""
    return f"{first}(?<!{_WORD}{first})"


# The default rule table (category, identifier type, pattern).
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("email", "direct", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
         "An email address reaches one person directly.", needs="@"),
    Rule("ip address", "indirect", r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
         "An IP address can single out a person's device when combined with other data.",
         java=_lead(r"\d") + r"\d{0,2}\.(?:\d{1,3}\.){2}\d{1,3}" + _NW, needs="."),
    Rule("phone number", "direct", r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
         "A phone number reaches one person directly.", needs="+"),
    Rule("payment card", "direct", r"\b\d{16}\b",
         "A card number belongs to one account holder.",
         java=_lead(r"\d") + r"\d{15}" + _NW),
    Rule("device identifier", "indirect", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b",
         "A hardware address identifies one device and so its user.",
         java=_lead("[0-9A-Fa-f]") + r"[0-9A-Fa-f]:(?:[0-9A-Fa-f]{2}:){4}[0-9A-Fa-f]{2}" + _NW, needs=":"),
    Rule("national id", "direct", r"\b\d{3}-\d{2}-\d{4}\b",
         "A national identification number names one person.",
         java=_lead(r"\d") + r"\d{2}-\d{2}-\d{4}" + _NW, needs="-"),
    Rule("bank account", "direct", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
         "An account number belongs to one account holder.",
         java=_lead("[A-Z]") + r"[A-Z]\d{2}[A-Z0-9]{10,30}" + _NW),
    Rule("access token", "indirect", r"\b[0-9a-f]{40}\b",
         "A secret token grants access tied to one account.",
         java=_lead("[0-9a-f]") + r"[0-9a-f]{39}" + _NW),
)

_ITEMS_TYPE = "array<struct<text:string,category:string,type:string,justification:string>>"


def luhn_valid(x: Column) -> Column:
    """Luhn checksum of a digit string: from the right, every second digit doubled (minus 9 above 9)."""
    n = F.length(x)

    def add(acc, i):
        d = F.substring(x, n - i + 1, 1).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def octets_valid(x: Column) -> Column:
    """Every dot-separated part of an IPv4 candidate is at most 255."""
    return F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255)


def luhn_digits_valid(x: Column) -> Column:
    """Luhn checksum over the digits of a number written in groups."""
    return luhn_valid(F.regexp_replace(x, "[ -]", ""))


CHECKS = {"luhn": luhn_valid, "octets": octets_valid, "luhn_digits": luhn_digits_valid}

# Forms beyond the default table, written in more than one way.
MORE_RULES: tuple[Rule, ...] = (
    Rule("phone number", "direct", r"\(\d{3}\) ?\d{3}-\d{4}\b", "A phone number reaches one person directly.", needs="("),
    Rule("phone number", "direct", r"\b\d{3}[ .-]\d{3}[ .-]\d{4}\b", "A phone number reaches one person directly."),
    Rule("phone number", "direct", r"\+\d{1,3}(?:[ .-]\d{2,4}){2,4}\b", "A phone number reaches one person directly.", needs="+"),
    Rule("ip address", "indirect", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b",
         "An IP address can single out a person's device when combined with other data.", needs=":"),
    Rule("payment card", "direct", r"\b\d{13,19}\b", "A card number belongs to one account holder.", check="luhn"),
    Rule("payment card", "direct", r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}\b", "A card number belongs to one account holder.",
         check="luhn_digits"),
    Rule("device identifier", "indirect", r"\b\d{15}\b", "An equipment number identifies one device and so its user.", check="luhn"),
    Rule("bank account", "direct", r"\b[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?\b",
         "An account number belongs to one account holder."),
)


def with_checks(rules: Sequence[Rule] = DEFAULT_RULES) -> tuple[Rule, ...]:
    """The rule table with the optional validations on: Luhn for cards, octet range for IPs."""
    extra = {"payment card": "luhn", "ip address": "octets"}
    return tuple(replace(r, check=extra.get(r.category, r.check)) for r in rules)


def rule_items(content: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """All matches of all rules in one chunk, as one item array (rule order, then match order)."""
    def as_item(r: Rule):
        return lambda x: item_struct(x, F.lit(r.category), F.lit(r.type), F.lit(r.justification))

    def one(r: Rule) -> Column:
        matches = F.regexp_extract_all(content, F.lit(r.java_pattern), 0)
        if r.check:
            matches = F.filter(matches, CHECKS[r.check])
        found = F.transform(matches, as_item(r))
        if r.needs:
            found = F.when(F.instr(content, r.needs) > 0, found).otherwise(F.array().cast(_ITEMS_TYPE))
        return found

    per_rule = [one(r) for r in rules]
    return per_rule[0] if len(per_rule) == 1 else F.concat(*per_rule)


def _explode_items(chunks: DataFrame, items: Column, round_: Column, pos_offset: int = 0) -> DataFrame:
    exploded = chunks.select(
        F.col("doc_id"), F.col("chunk_index"), round_.alias("round"), F.posexplode(items).alias("item_pos", "item")
    )
    return exploded.select(
        "doc_id",
        "chunk_index",
        F.col("round").cast("int").alias("round"),
        (F.col("item_pos").cast("long") + F.lit(pos_offset)).alias("item_pos"),
        "item.text",
        "item.category",
        "item.type",
        "item.justification",
    )


def _round_col(chunks: DataFrame, round_: int | None) -> Column:
    if round_ is not None:
        return F.lit(round_)
    return F.col("round") if "round" in chunks.columns else F.lit(0)


def detect_rules(chunks: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, round_: int | None = None,
                 pos_offset: int = 0) -> DataFrame:
    """Rule-based items of every chunk. Chunks with no match give no row."""
    items = rule_items(F.col("content"), rules)
    return _explode_items(chunks, items, _round_col(chunks, round_), pos_offset)


# --- dictionary ---------------------------------------------------------------

TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
_TOKEN_CLASS = r"[\p{L}\p{N}_]"
_NON_TOKEN_CLASS = r"[^\p{L}\p{N}_]"
# Zero-width split at every token/non-token boundary: pieces alternate between
# tokens and separators and concatenate back to the text.
BOUNDARY_SPLIT = f"(?<={_TOKEN_CLASS})(?={_NON_TOKEN_CLASS})|(?<={_NON_TOKEN_CLASS})(?={_TOKEN_CLASS})"


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows (counted, not assumed)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def terms_table(spark, terms: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """(term, category, type, justification) rows as a DataFrame, built from JVM literals.

    For a term list given in code; large dictionaries should be read as a table.
    """
    rows = [F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("term", "category", "type", "justification"), t)])
            for t in terms]
    if not rows:
        return spark.createDataFrame([], "term string, category string, type string, justification string")
    return spark.range(1).select(F.inline(F.array(*rows)))


#: A dictionary up to this size (counted, not assumed) goes to the tasks as a trie.
TRIE_TERMS, TRIE_BYTES = 1_000_000, 64 << 20


class Trie:
    """Terms by their token keys: ``children[key]`` of the root, then of each node; a node's items end there."""

    def __init__(self, terms: Iterable[tuple[str, str, str, str]]):
        self.root: tuple[dict, list] = ({}, [])
        tokens = _token_regex()
        for term, *item in terms:
            node = self.root
            for token in tokens.findall(term or ""):
                node = node[0].setdefault(python_match_key(token), ({}, []))
            if node is not self.root and item not in node[1]:  # a term may have several categories
                node[1].append(item)
        first = self.root[0]

        class Known(dict):
            """The node of a token's key, None for most tokens; every distinct token is folded once."""

            def __missing__(self, token):
                self[token] = first.get(python_match_key(token))
                return self[token]

        self.known = Known()

    def find(self, content: str, tokens) -> list[tuple[int, str, list]]:
        """(number of the first token, text as written, item) of every match."""
        known = self.known
        found, out, spans = [(i, n) for i, t in enumerate(tokens.findall(content)) if (n := known[t]) is not None], [], None
        for i, node in found:
            if spans is None:
                spans = [m.span() for m in tokens.finditer(content)]
            at = i
            while True:
                out += [(i, content[spans[i][0] : spans[at][1]], item) for item in node[1]]
                if not node[0] or at + 1 == len(spans) or not content[spans[at][1] : spans[at + 1][0]].isspace():
                    break
                node = node[0].get(python_match_key(content[slice(*spans[at + 1])]))
                if node is None:
                    break
                at += 1
        if len(known) > 1_000_000:
            known.clear()
        return out


def _token_regex():
    import regex

    return regex.compile(TOKEN_PATTERN)


#: The trie that a worker process built last, by the name of its dictionary.
_TRIES: dict[str, Trie] = {}


def _detect_with_trie(chunks: DataFrame, terms: list[tuple], round_: int | None, pos_offset: int) -> DataFrame:
    """Rows of matches alone leave a task; tokens never become rows."""
    spark = chunks.sparkSession
    ship_package(spark)
    sent, name = spark.sparkContext.broadcast(terms), uuid.uuid4().hex
    source = chunks.select(F.col("doc_id"), "chunk_index", _round_col(chunks, round_).cast("int").alias("round"), "content")
    out = source.select("doc_id", "chunk_index", "round").schema
    for column, kind in (("item_pos", "long"), ("text", "string"), ("category", "string"), ("type", "string"), ("justification", "string")):
        out = out.add(column, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (trie := _TRIES.get(name)) is None:
            _TRIES.clear()
            trie = _TRIES[name] = Trie(sent.value)
        tokens = _token_regex()
        for b in batches:
            rows = [(k, *m) for k, c in enumerate(b.column(3).to_pylist()) if c for m in trie.find(c, tokens)]
            at = pa.array([r[0] for r in rows], pa.int64())
            items = [pa.array([r[3][j] for r in rows], pa.string()) for j in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(j).take(at) for j in range(3)], pa.array([r[1] + pos_offset for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.string()), *items], names=out.names)

    return source.mapInArrow(run, out)


def _small_dictionary(terms: DataFrame) -> list[tuple] | None:
    """The terms as rows if their number and bytes are within the bounds, both measured."""
    plain = terms.select(*[F.col(c).cast("string").alias(c) for c in ("term", "category", "type", "justification")])
    if plain.limit(TRIE_TERMS + 1).count() > TRIE_TERMS:
        return None
    size = plain.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in plain.columns))).first()[0] or 0
    return [tuple(r) for r in plain.collect()] if size <= TRIE_BYTES else None


def detect_dictionary(chunks: DataFrame, terms: DataFrame, round_: int | None = None, pos_offset: int = 0,
                      broadcast_max_rows: int = 1_000_000, trie: bool = True) -> DataFrame:
    """Token sequences equal (accent- and case-insensitively) to a dictionary term.

    A term of several tokens ("John Doe") matches the same tokens separated by
    whitespace only. The found text is the span as written in the chunk;
    ``item_pos`` is the position of its first token among the chunk's tokens.

    A dictionary within ``TRIE_TERMS`` rows and ``TRIE_BYTES`` goes to the tasks
    as a trie of token keys, and only matches become rows. A larger one (or
    ``trie=False``) is joined: tokens become rows, candidates come from an
    equi-join on the first token's key, and the following tokens are checked
    in-row against a window no longer than the longest term.
    """
    if trie and (rows := _small_dictionary(terms)) is not None:
        return _detect_with_trie(chunks, rows, round_, pos_offset)
    keyed_terms = (
        terms.select(F.transform(F.regexp_extract_all(F.col("term"), F.lit(TOKEN_PATTERN), 0), lambda t: match_key(t)).alias("keys"),
                     "category", "type", "justification")
        .where(F.size("keys") > 0)
        .dropDuplicates(["keys", "category", "type", "justification"])  # a term may have several categories
        .withColumn("key", F.col("keys")[0])
    )
    longest = keyed_terms.agg(F.max(F.size("keys"))).first()[0] or 1  # one scalar
    keyed_terms = checked_broadcast(keyed_terms, broadcast_max_rows)
    if longest == 1:
        # single-token terms only: tokens alone, no separators to check
        single = chunks.select(
            "doc_id", "chunk_index", _round_col(chunks, round_).cast("int").alias("round"),
            F.posexplode(F.regexp_extract_all(F.col("content"), F.lit(TOKEN_PATTERN), 0)).alias("item_pos", "text"),
        ).withColumn("key", match_key(F.col("text")))
        return single.join(keyed_terms.drop("keys"), "key").select(
            "doc_id", "chunk_index", "round", (F.col("item_pos").cast("long") + F.lit(pos_offset)).alias("item_pos"),
            "text", "category", "type", "justification")
    width = 2 * longest - 2

    # The piece array is a column referenced twice below, so it is split once
    # per chunk (not once per piece inside the lambda).
    split = chunks.select(
        "doc_id", "chunk_index", _round_col(chunks, round_).cast("int").alias("round"),
        F.split(F.col("content"), BOUNDARY_SPLIT).alias("_pieces"),
    )
    pieces = F.col("_pieces")
    entries = F.filter(
        F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("tok"), F.slice(pieces, i + 2, width).alias("rest"))),
        lambda e: e["tok"].rlike("^" + _TOKEN_CLASS),
    )
    skip = F.when(pieces[0].rlike("^" + _TOKEN_CLASS), 0).otherwise(1)
    tokens = split.select("doc_id", "chunk_index", "round", skip.alias("_skip"), F.explode(entries).alias("e")) \
        .select("doc_id", "chunk_index", "round", "_skip", "e.i", "e.tok", "e.rest", match_key(F.col("e.tok")).alias("key"))
    hits = tokens.join(keyed_terms, "key")

    n = F.size("keys")
    rest = F.col("rest")
    following_match = F.forall(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda k: (n == 1) | (
            F.coalesce(F.try_element_at(rest, 2 * k - 1), F.lit("x")).rlike(r"^[" + PY_SPACE + r"]+$")
            & (match_key(F.coalesce(F.try_element_at(rest, 2 * k), F.lit(""))) == F.try_element_at(F.col("keys"), k + 1))
        ),
    )
    text = F.concat(F.col("tok"), F.array_join(F.slice(rest, 1, 2 * (n - 1)), ""))
    return hits.where(following_match).select(
        "doc_id",
        "chunk_index",
        "round",
        (F.floor((F.col("i") - F.col("_skip")) / 2).cast("long") + F.lit(pos_offset)).alias("item_pos"),
        F.when(n == 1, F.col("tok")).otherwise(text).alias("text"),
        "category",
        "type",
        "justification",
    )


# --- caller-supplied function (model client extension point) ------------------

# Own wording: instruction for an external extractor (D4). "{text}" is replaced by the chunk.
PROMPT_TEMPLATE = (
    "List every piece of personal data in the text below as a JSON array of objects "
    "with the keys text (exactly as written), category, type (direct or indirect) and "
    "justification. Answer with the array inside a ```json fence; answer [] if there is none.\n\n"
    "Text:\n{text}\n"
)


def render_prompt(content: Column, template: str = PROMPT_TEMPLATE) -> Column:
    """The instruction text for one chunk."""
    return F.replace(F.lit(template), F.lit("{text}"), content)


def answers_with(chunks: DataFrame, answer: Callable[[pd.Series], pd.Series] | None = None,
                 round_: int | None = None, use_prompt: bool = False, rebalance: int | None = None,
                 setup: Callable[[], Callable[[pd.Series], pd.Series]] | None = None) -> DataFrame:
    """D3: raw answers of a caller's function: ``doc_id, chunk_index, round, answer``.

    ``answer`` receives a pandas Series of texts (one Arrow batch) and returns
    a Series of answers. Alternatively ``setup`` is called once per task to
    build that function (open a client or load a model once, not per batch).
    ``rebalance`` spreads chunks over that many partitions first, worth it
    when the function is costly per chunk.
    """
    if (answer is None) == (setup is None):
        raise ValueError("give exactly one of answer or setup")
    ship_package(chunks.sparkSession)
    src = chunks.select("doc_id", "chunk_index", _round_col(chunks, round_).cast("int").alias("round"),
                        (render_prompt(F.col("content")) if use_prompt else F.col("content")).alias("content"))
    if rebalance:
        src = src.repartition(rebalance, "doc_id", "chunk_index")

    def run(batches):
        fn = answer if setup is None else None
        for pdf in batches:
            if fn is None:
                fn = setup()
            out = pdf[["doc_id", "chunk_index", "round"]].copy()
            out["answer"] = fn(pdf["content"]).astype(object).values if len(pdf) else []
            yield out

    return src.mapInPandas(run, "doc_id string, chunk_index int, round int, answer string")


def split_rejects(answers: DataFrame, require_fence: bool = True, pos_offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Answers -> (item rows, rejects ``doc_id, chunk_index, round, reason, rejected``).

    An answer that fails the fence or JSON gate is a reject with its text; so is
    an item without text or document, with the item as JSON. Both results read
    ``answers``, so write it first when it is costly.
    """
    reason = reject_reason(F.col("answer"), require_fence)
    parsed = answers.select("doc_id", "chunk_index", "round", parse_items(strip_fence(F.col("answer"), require_fence)).alias("items"))
    rows = _explode_items(parsed.where(F.col("items").isNotNull()), F.col("items"), F.col("round"), pos_offset)
    good = F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.col("doc_id") != "")
    bad_answers = answers.select("doc_id", "chunk_index", "round", reason.alias("reason"), F.col("answer").alias("rejected"))
    bad_items = rows.where(~good).select(
        "doc_id", "chunk_index", "round", F.when(F.col("text").isNull(), "item without text").otherwise("no document").alias("reason"),
        F.to_json(F.struct("text", "category", "type", "justification")).alias("rejected"))
    return rows.where(good), bad_answers.where("reason is not null").unionByName(bad_items)


def detect_with(chunks: DataFrame, answer: Callable[[pd.Series], pd.Series] | None = None,
                round_: int | None = None, require_fence: bool = True, use_prompt: bool = False,
                rebalance: int | None = None, pos_offset: int = 0,
                setup: Callable[[], Callable[[pd.Series], pd.Series]] | None = None) -> DataFrame:
    """Item rows of a caller's function (see :func:`answers_with`); bad answers give no items.

    Use :func:`answers_with` and :func:`split_rejects` to keep them as rejects.
    """
    return split_rejects(answers_with(chunks, answer, round_, use_prompt, rebalance, setup), require_fence, pos_offset)[0]
