"""mnemoframe: conversational-memory analytics on Spark DataFrames."""
