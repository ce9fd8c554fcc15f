"""docnav: grounded question answering over multi-page documents, as Spark DataFrames."""
