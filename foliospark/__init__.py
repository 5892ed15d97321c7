"""Document analytics on Spark: sources, text functions, operators, reading plans and streaming sinks."""

__version__ = "0.1.0"
