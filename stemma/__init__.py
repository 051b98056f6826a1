"""Search and analysis of a corpus of long documents, on Spark DataFrames."""
