"""flowlens: labelled-flow analytics as PySpark DataFrame jobs."""
