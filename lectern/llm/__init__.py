"""Operators for preparing training text: near-duplicates, decontamination,
language, sharding, quality, toxicity, token files and URL reputation.

Nothing outside this sub-package imports it.  ``queries`` holds the
registered queries, ``oracle`` their SQL twins.
"""
