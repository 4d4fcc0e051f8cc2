"""Structured Streaming forms of the ordered rules, the sinks and the alerts."""
