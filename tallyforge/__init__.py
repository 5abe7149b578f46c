"""Double-entry ledger analytics on Spark DataFrames."""
