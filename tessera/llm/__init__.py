"""Training-data operators: scoring, filtering, extraction, de-duplication, packing and tokenising.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
