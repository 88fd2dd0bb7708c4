"""Network-flow and security-event analytics expressed as Spark DataFrame plans."""
