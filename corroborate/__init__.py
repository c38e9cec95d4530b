"""Evidence retrieval, grounding and evaluation on Spark."""
