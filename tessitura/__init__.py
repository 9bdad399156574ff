"""An analytics engine for score and page relations, on Spark DataFrames."""
