"""palimpsest: document-quality analytics and corpus curation on PySpark DataFrames."""

__version__ = "0.1.0"
