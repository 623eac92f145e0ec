"""corpusledger: source-grounded corpus analytics on Spark DataFrames."""
