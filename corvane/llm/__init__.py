"""Training-data operators over the corpus tables.

Nothing else in the library imports this subpackage, so it can be removed whole.
"""
