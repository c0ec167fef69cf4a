"""Network-evidence analytics on Spark: captures and logs in, sourced findings out."""

__version__ = "0.1.0"
