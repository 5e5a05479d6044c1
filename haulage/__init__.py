"""Spark jobs for moving, auditing and packaging very large file estates."""
