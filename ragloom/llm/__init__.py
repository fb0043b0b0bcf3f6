"""Training-data operators: token counts, filters, near duplicates, packing and the like.

Nothing outside this subpackage imports it.
"""
