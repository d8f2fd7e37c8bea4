"""Operators for building text training sets: packing, language id, dedup, secrets, quality, urls, shards, BPE.

Nothing else in the library imports this package.  ``queries.QUERIES`` holds the
registered queries, ``queries.ORACLES`` their SQL where SQL can express them.
"""
