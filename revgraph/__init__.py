"""revgraph: version-control analytics and training-data preparation on Spark DataFrames."""
