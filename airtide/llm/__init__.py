"""Training-data operators: archives, deduplication, packing, mixing, scanning and labelling.

Nothing else in the package imports this subpackage; ``queries.py`` registers its queries.
"""
