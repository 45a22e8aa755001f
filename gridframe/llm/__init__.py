"""Training-data operators over a table of documents.

Nothing else in the library imports this subpackage.  Each ``opN_*`` module
holds one operator with a general interface; ``queries`` holds the registered
queries, which derive the digest columns from the operators' outputs.
"""
