"""linkloom: record linkage, URL analytics and text-corpus operators on Spark DataFrames."""
