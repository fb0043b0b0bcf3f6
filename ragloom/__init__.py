"""ragloom: hybrid retrieval and text curation over Spark DataFrames."""
