"""Query operators over request tables."""
