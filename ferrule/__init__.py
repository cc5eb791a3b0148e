"""File diagnostics and data-quality analytics as Spark jobs."""
