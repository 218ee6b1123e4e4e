"""Facts to graphs, imports, chunks, search and traversal."""
