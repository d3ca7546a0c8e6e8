"""Document retrieval, log analytics and data cleaning on Spark DataFrames."""
