"""The queries that the driver runs."""
