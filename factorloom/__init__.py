"""Cross-sectional factor research engine expressed as Spark DataFrame plans."""
