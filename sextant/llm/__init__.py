"""Operators for preparing language-model training corpora on Spark.

Nothing outside this package imports it; ``sextant.llm.queries`` registers its
queries when the package is present.
"""
