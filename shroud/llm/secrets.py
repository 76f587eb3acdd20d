"""Secret scans over history by an incremental blob ledger (operator 7).

Native: DataFrame operations only. Every version of every path is addressed by
the SHA-256 of its content. Only (blob, rule version) pairs that the ledger does
not hold are scanned, each once, whichever paths share the blob; findings are
joined back to all paths by blob. The text of a blob is read from one version
that has it, chosen by its key, so a blob that a third of all versions share
does not meet in one task.

Positions come from splitting the content by the rule's pattern: the gaps before
a match and the matches before it add up to its start. They count code points;
the end is exclusive. Matches are leftmost and do not overlap within a rule; a
match that fails the rule's length is dropped, not retried.

Defined results: null content is empty content; empty content has no findings;
repeated rows and several paths with one content get equal findings; null paths
and versions are values of their own; an empty table gives an empty ledger and
no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.common import materialize, row_key, small_side


@dataclass(frozen=True)
class Rule:
    """``pattern``'s matches whose group ``value_group`` has at least ``min_length`` characters."""

    kind: str
    version: int
    pattern: str
    min_length: int = 1
    value_group: int = 0
    base: bool = True

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = [
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
]


def address(content: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")), 256))


def addressed(versions: DataFrame) -> DataFrame:
    """(path, version, blob, vk) of ``versions`` (path, version, content); vk is the version's key."""
    blob = versions.select("path", "version", address(F.col("content")).alias("blob"))
    return blob.withColumn("vk", F.xxhash64(row_key("path", "version"), "blob"))


def unseen(light: DataFrame, ledger: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """(blob, vk, todo): blobs with rule versions not scanned yet, and the version to read them from."""
    blobs = light.groupBy("blob").agg(F.min("vk").alias("vk"))
    tags = F.array(*[F.lit(r.tag) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", tags)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))
    todo = F.array_except(tags, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "vk", todo.alias("todo")).filter(F.size("todo") > 0)


def _matches(rule: Rule, content: Column, todo: Column) -> Column:
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<string>")
    due = F.array_contains(todo, rule.tag) & content.rlike(rule.pattern)
    return F.struct(
        F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("rule_version"), F.lit(rule.min_length).alias("least"),
        F.when(due, F.regexp_extract_all(content, pattern, F.lit(0))).otherwise(none).alias("found"),
        F.when(due, F.regexp_extract_all(content, pattern, F.lit(rule.value_group))).otherwise(none).alias("value"),
        F.when(due, F.split(content, rule.pattern, -1)).otherwise(none).alias("gap"),
    )


def scan_blobs(versions: DataFrame, due: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, kind, rule_version, start, end) of the due pairs; ``due`` is ``unseen``'s table, written."""
    keyed = versions.select("content", address(F.col("content")).alias("blob"),
                            row_key("path", "version").alias("pv")).withColumn("vk", F.xxhash64("pv", "blob"))
    texts = keyed.select("vk", F.coalesce("content", F.lit("")).alias("content"))
    texts = texts.join(due.hint("shuffle_hash"), "vk")
    # rules are tried inside the generator, where no filter on the text can move below the join:
    # a text that is not due is not read by any pattern
    per_rule = texts.select(
        "blob", F.explode(F.array(*[_matches(r, F.col("content"), F.col("todo")) for r in rules])).alias("m"))
    each = per_rule.select(
        "blob", "m.kind", "m.rule_version", "m.least",
        F.posexplode(F.arrays_zip("m.found", "m.value", F.slice("m.gap", F.lit(1), F.size("m.found")).alias("gap")))
    ).select("blob", "kind", "rule_version", "least", "pos", F.length("col.found").alias("size"),
             F.length("col.value").alias("value_size"), F.length("col.gap").alias("gap"))
    upto = Window.partitionBy("blob", "kind", "rule_version").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    placed = each.dropDuplicates(["blob", "kind", "rule_version", "pos"]).withColumn("end", end)
    return placed.filter("value_size >= least").select(
        "blob", "kind", "rule_version", (F.col("end") - F.col("size")).cast("long").alias("start"),
        F.col("end").cast("long").alias("end"))


def scan_history(versions: DataFrame, rules: list[Rule] = RULES, ledger: DataFrame | None = None,
                 findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, findings, versions by blob) after scanning what is new in ``versions`` (path, version, content).

    The ledger has one row per blob and scan, (blob, scanned rule versions); findings are kept by blob.
    All three are written tables, so the next call can start from them.
    """
    light = materialize(addressed(versions), "versions")
    due = materialize(unseen(light, ledger, rules), "due-blobs")
    found = scan_blobs(versions, due, rules)
    found = materialize(found if findings is None else findings.unionByName(found), "findings")
    new = due.select("blob", F.col("todo").alias("scanned"))
    ledger = new if ledger is None else materialize(ledger.unionByName(new), "ledger")
    return ledger, found, light


def by_blob(findings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per blob with findings of ``rules``: counts per base kind, and all spans by start and kind."""
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.tag, rules.index(r))])
    rank = F.element_at(current, F.concat_ws("@", "kind", "rule_version"))
    base = [r for r in rules if r.base]
    spans = findings.withColumn("rank", rank).filter("rank is not null").groupBy("blob").agg(
        *[F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in base],
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))
    text = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    own = F.filter("spans", lambda s: s["rank"].isin([i for i, r in enumerate(rules) if r.base]))
    return spans.select("blob", *[f"n_{r.kind}" for r in base], F.sha2(text(own), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


def findings_by_path(light: DataFrame, findings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(path, version, blob, n_<kind>..., base_sha256, spans) of every version."""
    table = materialize(by_blob(findings, rules), "findings-by-blob")
    kinds = [f"n_{r.kind}" for r in rules if r.base]
    joined = light.join(small_side(table), "blob", "left")
    return joined.select(
        "path", "version", "blob", *[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in kinds],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))
