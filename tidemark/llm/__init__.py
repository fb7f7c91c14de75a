"""Operators for preparing training corpora.

Nothing outside this subpackage imports it: deleting it (with ``tests/llm`` and
``corpus_pipeline.py``) leaves the rest of the library working.
"""
