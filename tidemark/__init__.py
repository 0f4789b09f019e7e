"""Event, indicator and sketch analytics expressed as Spark DataFrame plans."""
