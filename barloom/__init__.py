"""barloom: a Spark-first engine for factor research and data curation."""

__version__ = "0.1.0"
