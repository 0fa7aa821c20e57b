"""Document sanitisation and text analytics over whole collections, on Spark DataFrames."""
