"""letterworks: document analytics over whole corpora, as Spark DataFrame work."""
