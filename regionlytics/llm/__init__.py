"""Training-data operators: filters, deduplication, mixing and tokenising of text at scale.

Nothing else in the library imports this subpackage.
"""
