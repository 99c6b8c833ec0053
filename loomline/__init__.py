"""loomline: retrieval and corpus analytics built from Spark DataFrames."""
