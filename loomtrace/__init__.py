"""loomtrace: document analytics and traceability over Spark DataFrames."""
