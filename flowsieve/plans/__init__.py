"""End-to-end jobs, the method registry and the query catalogue."""
