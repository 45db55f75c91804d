"""Operators for preparing language-model training data at corpus scale.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Each module
holds one operator with a general interface, the thin ``opN_*`` query over a
test table, and its SQL where SQL can express it. ``catalogue`` collects them.
"""
