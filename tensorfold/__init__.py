"""tensorfold: named n-dimensional arrays and training corpora as Spark DataFrames."""

__version__ = "0.1.0"
