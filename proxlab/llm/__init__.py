"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; ``queries.py`` registers its queries, and the
entry module adds them only if the subpackage can be imported.
"""
