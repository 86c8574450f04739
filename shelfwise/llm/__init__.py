"""Operators that prepare training text for language models.

Nothing outside this package imports it; ``__spark_entry__.py`` registers its
queries when the package is present.
"""
