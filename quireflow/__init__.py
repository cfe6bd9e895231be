"""Document structure, pairing, state and audits over many books, as Spark DataFrames."""
