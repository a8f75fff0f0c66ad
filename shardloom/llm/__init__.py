"""Training-data operators: filters, near-duplicate removal, mixing, formatting, output.

Nothing outside this subpackage imports it.
"""
