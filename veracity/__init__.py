"""Knowledge-graph quality analytics expressed as Spark DataFrame plans."""
