"""Query-to-code retrieval data sets on Spark: every operator maps DataFrames to DataFrames."""
