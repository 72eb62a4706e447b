"""Evidence analytics on Spark: retrieval, graph, governance and evaluation operators as DataFrames."""
