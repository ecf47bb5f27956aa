"""shelfmark: versioned catalog and content analytics on Spark DataFrames."""
