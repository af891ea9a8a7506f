"""XML analytics over DataFrames of documents."""
