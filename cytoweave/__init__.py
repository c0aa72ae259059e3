"""Cell and embedding analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame.  Rows are keyed by
``cell_id`` / ``gene_id`` / ``proto_id``; nothing depends on row position.
"""

__version__ = "0.1.0"
