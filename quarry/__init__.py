"""quarry: retrieval, text analytics and training-data operators as Spark DataFrame programs."""
