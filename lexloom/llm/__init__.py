"""Training-data operators: search, classifiers, filters, formatting, mixing, dedup and tokenising.

Nothing else in the library imports this subpackage.
"""
