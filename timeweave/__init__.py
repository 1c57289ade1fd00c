"""timeweave: temporal property-graph analytics as Spark DataFrames."""
