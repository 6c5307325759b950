"""Spark analytics for digitised engineering drawings: boxes, tags, ink and connectivity over many sheets at once."""
