"""Training-data operators (deduplication, filtering, scoring, mixing).

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
