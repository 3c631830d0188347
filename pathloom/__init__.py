"""Path-style analytics over entity-relationship catalogs, planned on Spark DataFrames."""
