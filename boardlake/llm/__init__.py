"""Training-data operators: filters, near-duplicate search, fingerprints, packing and token files.

Nothing else in the library imports this subpackage.
"""
