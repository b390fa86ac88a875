"""Safety-signal analytics expressed as Spark DataFrame plans."""
