"""voxloom: speech-corpus curation and analytics on Spark DataFrames."""
