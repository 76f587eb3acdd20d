"""Plan shape checks: no cartesian products, co-partitioned masking join, filters below Python."""

from conftest import SF_SMALL
from shroud.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark):
    for name in ["mask_documents", "chunks_with_items", "detect_dictionary", "findings"]:
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_row_local_queries_move_no_text(spark):
    """Nothing but the rebalancing of an under-split scan stands between the scan and the result."""
    for name in ["detect_rules", "chunk_fixed", "prompt_column", "chunk_recursive", "chunk_tidy", "model_detect"]:
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "hashpartitioning(doc_id" not in p, name


def test_one_evaluation_before_the_explode(spark):
    p = plan(QUERIES["chunk_recursive"](spark, SF_SMALL))
    assert p.count("ArrowEvalPython") == 1
    cleaned = plan(QUERIES["detect_rules_pages"](spark, SF_SMALL))
    assert cleaned.count("<!--") == plan(QUERIES["clean_pages"](spark, SF_SMALL)).count("<!--")


def test_blank_filter_before_python(spark):
    from shroud.operators.detect import detect_with

    chunks = QUERIES["chunk_tidy"](spark, SF_SMALL)
    p = plan(detect_with(chunks, lambda s: s, round_=0))
    assert p.index("MapInPandas") < p.index("RLIKE(content")  # the filter sits below (printed after) the Python node
