"""Decision-tree ensembles on mixed numeric and categorical tables with missing values, as Spark DataFrame operations."""
