"""Evidence-first analytics over source repositories and text corpora, on Spark DataFrames."""
