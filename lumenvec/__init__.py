"""lumenvec: labelled-vector analytics on Spark DataFrames."""
