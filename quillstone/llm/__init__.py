"""Training-data operators: dedup, scoring, tokenising, packing and formatting of large corpora.

Nothing outside this package imports it.  ``llm.catalog`` lists the queries.
"""
