"""tidemill: config-driven data work as PySpark DataFrame operators."""
