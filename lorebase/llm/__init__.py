"""Operations of a training-data pipeline over ``documents``, ``embeddings`` and ``pages``.

Nothing outside this subpackage imports it.
"""
