"""Point-in-time market analytics expressed as Spark DataFrame plans."""
