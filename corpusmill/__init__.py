"""corpusmill: web-corpus, retrieval and price-intelligence operators as PySpark plans."""

__version__ = "0.1.0"
