"""Operators for preparing large text corpora.

Nothing outside this package imports it; the queries it offers are listed in
:mod:`servicepulse.llm.queries`.
"""
