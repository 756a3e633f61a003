"""Analytics of customer conversations and knowledge corpora on Spark DataFrames."""
