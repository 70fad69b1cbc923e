"""tessera: a Spark-first engine for document knowledge graphs and corpus analytics."""

__version__ = "0.1.0"
