"""Content screening for retrieval corpora, expressed as Spark plans."""

__version__ = "0.1.0"
