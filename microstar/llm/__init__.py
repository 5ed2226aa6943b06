"""Training-data operators: tokenizing, searching, deduplicating, filtering and packing text corpora.

Each module holds one operator with its own interface; ``queries`` applies
them to the registered tables.  Nothing outside this subpackage imports it.
"""
