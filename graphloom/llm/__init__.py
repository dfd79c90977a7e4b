"""Operators for preparing training corpora at scale.

Nothing outside this subpackage imports it; its queries are listed in
``graphloom.llm.queries`` and in ``corpus_pipeline`` at the repository top.
"""
