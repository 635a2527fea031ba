"""Whole runs composed from sources, operators and sinks."""
