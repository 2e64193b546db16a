"""Usage-ledger analytics as Spark DataFrames."""
