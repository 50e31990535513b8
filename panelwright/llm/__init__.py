"""Operators of a training-data pipeline over documents, pages and embeddings. Nothing else in the library imports this."""
