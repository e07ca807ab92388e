"""Text search and retrieval analytics on Spark."""
