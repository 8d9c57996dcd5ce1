"""Training-data operators: tokenising, deduplication, search, cleaning, packing and archives.

Nothing outside this subpackage imports it; the driver entry adds its queries if it is present.
"""
