"""Sources of embeddings: local models and HTTP services, and their use over a column."""
