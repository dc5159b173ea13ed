"""Training-data operators: near-duplicates, filters, classifiers, archives and mixing.

Nothing outside this subpackage imports it.
"""
