"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general ``DataFrame -> DataFrame`` interface; ``queries`` derives the
registered ``opN_*`` results from them.
"""
