"""Training-data operators: deduplication, decontamination, quality, formatting, mixing.

Nothing else in the library imports this subpackage.
"""
