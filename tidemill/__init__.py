"""Analytics over conversational commerce data, on Spark DataFrames."""
