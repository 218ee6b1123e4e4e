"""Column expressions: identifiers, vectors, embeddings."""
