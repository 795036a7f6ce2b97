"""curaspark: curation of labelled text collections on Spark DataFrames."""
