"""Air-quality feature, label, evaluation and forecast jobs on Spark DataFrames."""
