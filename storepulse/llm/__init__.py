"""Training-data operators: deduplication, sharding, similarity joins, privacy,
tokenisation, search, packing, quality scoring and HTML extraction.

Each operator is a module of its own with a general ``DataFrame -> DataFrame``
interface; ``queries`` registers one production query per operator.
"""
