"""End-to-end detection: documents -> chunks -> rounds of detect + mask -> findings.

``scan_rounds`` is the loop L1-L3 as a bounded driver loop over DataFrames. The
base chunks are written once, in their scan partitions; a round writes its
detections and, as a delta, only the chunks that masking changed. Unchanged
text is never shuffled or rewritten: masking meets the base table through a
semi-join on the documents that have items. All tables are plain files in the
shared checkpoint folder, so a lost executor recomputes from the last round's
tables; nothing is left in the catalog, and ``RoundsResult.drop_chunks``
removes the text tables once the detections are all that is wanted.

Work units of masking are ``(doc_id, grp)``: groups of ``group_chunks`` chunks
for long documents, so one document does not land in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.functions.text import clean_text
from shroud.operators.chunk import DEFAULT_OVERLAP, DEFAULT_SIZE, chunk_documents, examinable
from shroud.operators.detect import DETECTION_COLS, POS_STRIDE, DEFAULT_RULES, Rule, detect_dictionary, detect_rules
from shroud.operators.findings import findings
from shroud.operators.mask import DEFAULT_MAX_INLINE_ITEMS, doc_items, masked_changes
from shroud.operators.metrics import observed
from shroud.operators.partitioning import drop_table, save_table, spread

Detector = Callable[[DataFrame, int], DataFrame]

# Chunks per work unit of a long document (about 1 MB of text at 1,024 characters a chunk).
DEFAULT_GROUP_CHUNKS = 1024


def deterministic(detector: Detector) -> Detector:
    """Mark a detector that finds the same items in the same text again."""
    detector.deterministic = True
    return detector


def rules_detector(rules: Sequence[Rule] = DEFAULT_RULES) -> Detector:
    return deterministic(lambda chunks, r: detect_rules(chunks, rules, round_=r))


def first_match_detector(rules: Sequence[Rule] = DEFAULT_RULES) -> Detector:
    """Rules that report one item a chunk, as a terse model would; masking it lets the next round see the next."""
    return deterministic(lambda chunks, r: detect_rules(chunks, rules, round_=r).where("item_pos = 0"))


def dictionary_detector(terms: DataFrame) -> Detector:
    return deterministic(lambda chunks, r: detect_dictionary(chunks, terms, round_=r))


def combined_detector(*detectors: Detector) -> Detector:
    """Union of detectors; detector k numbers its items from k * POS_STRIDE."""

    def run(chunks: DataFrame, r: int) -> DataFrame:
        out = None
        for k, d in enumerate(detectors):
            part = d(chunks, r).withColumn("item_pos", F.col("item_pos") + F.lit(k * POS_STRIDE))
            out = part if out is None else out.unionByName(part)
        return out

    return deterministic(run) if all(getattr(d, "deterministic", False) for d in detectors) else run


@dataclass
class RoundsResult:
    detections: DataFrame
    chunks: DataFrame | None
    rounds_run: int
    per_round: list[int] = field(default_factory=list)
    observations: dict = field(default_factory=dict)
    tables: list[DataFrame] = field(default_factory=list)

    def drop_chunks(self) -> RoundsResult:
        """Delete the chunk tables; the detections are tables of their own and stay."""
        for t in self.tables:
            drop_table(t)
        self.tables, self.chunks = [], None
        return self

    def stage_counts(self) -> dict[str, int]:
        """P5: rows per stage, gathered by ``observe`` during the jobs that ran anyway."""
        out = {name: int(obs.get["rows"]) for name, obs in self.observations.items()}
        for r, n in enumerate(self.per_round):
            out[f"items_round_{r}"] = n
        return out


def scan_rounds(chunks: DataFrame, detector: Detector, max_rounds: int = 2, reprompt: bool = True,
                max_inline_items: int = DEFAULT_MAX_INLINE_ITEMS, reexamine: str = "auto",
                checkpoint: bool = True, mask_ignore_case: bool = False) -> RoundsResult:
    """L1-L3: detect, then (while rounds remain) mask and detect again.

    Round 0 examines every non-blank chunk. Later rounds examine the chunks
    that masking has changed and, as ``reexamine`` says, no others (``masked``),
    those of documents without items so far as well (``documents``), or every
    chunk (``all``). ``auto`` is ``masked`` for a detector that finds the same
    in the same text, where other chunks can give nothing new, and
    ``documents`` for any other, such as a model whose answer failed.
    The loop stops early when a round finds nothing. Items of all rounds so far
    mask every chunk of their document, case-sensitively unless
    ``mask_ignore_case``. Without ``checkpoint`` the tables are only persisted.
    """
    if max_rounds < 1:
        raise ValueError("max_rounds must be at least 1")
    if not reprompt:
        max_rounds = 1
    if reexamine == "auto":
        reexamine = "masked" if getattr(detector, "deterministic", False) else "documents"

    def keep(df: DataFrame, prefix: str) -> DataFrame:
        return save_table(df, prefix=prefix) if checkpoint else df.persist(StorageLevel.MEMORY_AND_DISK)

    part = ["doc_id", "grp"] if "grp" in chunks.columns else ["doc_id"]
    # _base tells several texts under one id apart, whatever masking makes of them
    base = keep(chunks.select(*part, "chunk_index", "content", F.xxhash64("content").alias("_base")), "chunks")
    tables, delta = [base], None
    all_dets, per_round = None, []

    def current() -> DataFrame:
        fresh = base.withColumn("changed", F.lit(False))
        if delta is None:
            return fresh
        rest = fresh.join(delta.select("doc_id", "chunk_index", "_base"), ["doc_id", "chunk_index", "_base"], "left_anti")
        return rest.select(*fresh.columns).unionByName(delta.withColumn("changed", F.lit(True)))

    for r in range(max_rounds):
        if r == 0:
            examine = base
        elif reexamine == "all":
            examine = current()
        else:
            examine = delta
            if reexamine == "documents":
                empty = base.join(all_dets.select("doc_id").distinct(), "doc_id", "left_anti")
                examine = examine.select(*base.columns).unionByName(empty.select(*base.columns))
        dets = keep(detector(examinable(examine).select("doc_id", "chunk_index", "content"), r).select(*DETECTION_COLS),
                    "detections")
        per_round.append(dets.count())
        all_dets = dets if all_dets is None else all_dets.unionByName(dets)
        if per_round[-1] == 0 or r == max_rounds - 1:
            break
        items = doc_items(all_dets)
        # texts of documents with items as they are now: what earlier rounds changed, else the base
        now = current().join(items.select("doc_id").distinct(), "doc_id", "left_semi") if delta is not None else base
        new = masked_changes(now.drop("changed"), items, max_inline_items, case_insensitive=mask_ignore_case)
        if delta is not None:
            ids = ["doc_id", "chunk_index", "_base"]
            new = new.select(*base.columns).unionByName(delta.join(new.select(*ids), ids, "left_anti").select(*base.columns))
        delta = keep(new.select(*base.columns), "changes")
        tables.append(delta)
    return RoundsResult(all_dets, current().drop("_base"), len(per_round), per_round, tables=tables)


def prepare_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean: bool = True) -> DataFrame:
    """Documents table -> ``doc_id STRING, content STRING``, in its scan partitions (rebalanced when under-split)."""
    out = spread(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("content")))
    return out.withColumn("content", clean_text(F.col("content"))) if clean else out


def detect_documents(docs: DataFrame, detector: Detector | None = None, size: int = DEFAULT_SIZE,
                     overlap: int = DEFAULT_OVERLAP, chunker: str = "recursive", max_rounds: int = 2,
                     reprompt: bool = True, id_col: str = "doc_id", text_col: str = "text",
                     clean: bool = True, checkpoint: bool = True,
                     group_chunks: int | None = DEFAULT_GROUP_CHUNKS) -> RoundsResult:
    """Documents -> detections of all rounds (everything before post-processing).

    Documents with more than ``group_chunks`` chunks are split into groups of
    that many chunks, each its own work unit (a document holding a large share
    of the data does not land in one task); ``None`` keeps one unit per document.
    """
    prepared, docs_obs = observed(
        prepare_documents(docs, id_col, text_col, clean), "documents")
    chunks, chunks_obs = observed(
        chunk_documents(prepared, size, overlap, method=chunker, group_size=group_chunks), "chunks")
    result = scan_rounds(chunks, detector or rules_detector(), max_rounds, reprompt, checkpoint=checkpoint)
    result.observations = {"documents": docs_obs, "chunks": chunks_obs}
    return result


def find_items(docs: DataFrame, **kwargs) -> DataFrame:
    """Documents -> findings rows (``id, round, chunk_index, item_pos, text, category, type, justification``)."""
    return findings(detect_documents(docs, **kwargs).drop_chunks().detections)
