"""Column expressions: text normalization, similarity, and scoring."""
