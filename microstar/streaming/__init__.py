"""Incremental (Structured Streaming) form of the layer loads.

Not a new operator: the same clean/curate/route code runs on micro-batches
of raw files as they arrive, with exactly-once sinks.
"""
