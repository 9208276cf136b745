"""Training-data operators: one module per operator, queries and SQL in ``registry``.

Nothing outside this package imports it; ``corpus_pipeline.py`` at the top of
the repository chains five of its operators.
"""
