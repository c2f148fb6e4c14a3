"""Training-data operators: filtering, de-duplication, extraction and packing.

Nothing outside this subpackage imports it.
"""
