"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``queries.py`` holds the registered
``opN_*`` queries and ``__spark_entry__`` adds them when the package is present.
"""
