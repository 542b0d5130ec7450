"""Training-data operators: ten numbered operators over the document and page tables.

Nothing outside this subpackage imports it.
"""
