"""Retrieval analytics on Spark: documents, chunks, rankings, graphs and their evaluation as DataFrame plans."""
