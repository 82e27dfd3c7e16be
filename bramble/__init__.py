"""bramble: fuzzy-rule and rule-graph analytics on Spark DataFrames."""
