"""Metric registry, query catalogue and batch table builds."""
