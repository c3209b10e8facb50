"""Analytics on Spark: relational, streaming and training-data operators as DataFrame programs."""
