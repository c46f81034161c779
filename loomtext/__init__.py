"""loomtext: text-context building and measurement as Spark DataFrame plans."""

__version__ = "0.1.0"
