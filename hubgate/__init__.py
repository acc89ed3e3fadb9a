"""Embedding retrieval analytics on Spark: hubness reranking, certificates, gates, metrics and data preparation."""
