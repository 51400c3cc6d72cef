"""sievework: tabular cleaning, resampling and classifier evaluation on Spark DataFrames."""
