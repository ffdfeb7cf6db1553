"""Training-data operators over the tables ``documents`` and ``embeddings``.

Nothing outside this subpackage imports it.
"""
