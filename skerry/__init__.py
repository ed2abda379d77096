"""Web-reconnaissance analytics on Spark DataFrames."""
