"""Reading text from files, hubs, Python values and DataFrames into frames of documents."""

from corploom.sources.reader import chain, from_table, read
from corploom.sources.stream import DocumentStream

__all__ = ["DocumentStream", "chain", "from_table", "read"]
