"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it; its queries and their SQL are in
``lumenloom.llm.queries``.
"""
