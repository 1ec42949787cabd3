"""Foliant: inventory, parse, audit and migrate corpora of shortcode documents with Spark."""
