"""Training-data operators: counting, filtering, tokenising, deduplicating, decontaminating and
sharding a corpus of documents, and reading and writing web archives.

Nothing else in the library imports this subpackage.  ``queries`` registers one query per operator.
"""
