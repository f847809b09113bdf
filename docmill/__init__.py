"""docmill: document-intelligence operators on Spark DataFrames."""
