"""millrace: document retrieval, question routing and operational analytics on PySpark."""

__version__ = "0.1.0"
