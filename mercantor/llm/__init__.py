"""Training-data operators: quality, decontamination, sharding, tokens, URLs, mixing, near copies, licences.

Nothing outside this subpackage imports it, so it can be removed without touching the rest.
"""
