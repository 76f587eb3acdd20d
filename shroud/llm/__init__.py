"""Operations of a training-data pipeline: packing, dedup, search, scoring, mixing, scanning.

Nothing outside this subpackage imports it, except ``corpus_pipeline.py`` and,
behind a guard, ``__spark_entry__.py``.
"""
