"""Training-data operators: filters, near-duplicate removal, scoring and token codecs.

Nothing outside this package imports it; ``queries`` holds the registered queries.
"""
