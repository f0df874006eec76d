"""Operators for building training corpora.

Ten operators over ``documents``/``pages``/``embeddings``/``benchmark``/``labels`` style
tables. Nothing else in the library imports this subpackage.
"""
