"""Operations of a training-data pipeline on documents and embeddings.

Nothing outside this package imports it; ``queries`` registers its queries.
"""
