"""Event-feature analytics on PySpark: declared schemas, strictly-prior windows, leakage-safe fits, audits and metrics."""

__version__ = "0.1.0"
