"""tidemark: a SQL and hybrid-retrieval engine on Spark DataFrames."""
