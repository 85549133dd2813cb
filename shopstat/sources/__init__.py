"""Inputs and outputs: role views, file scans, table sinks."""
