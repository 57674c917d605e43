"""The corpus: a chain of steps over a stream, its passes, statistics, provenance and storage."""
