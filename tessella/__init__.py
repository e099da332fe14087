"""Document-intelligence analytics expressed as PySpark DataFrame plans."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
