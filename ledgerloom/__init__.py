"""Receipt extraction and analytics over Spark DataFrames."""
