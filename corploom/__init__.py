"""Corpus building on Spark: read, filter, deduplicate, sample, mix, split, describe and save text."""

from corploom.document import Document
from corploom.plans.corpus import Corpus
from corploom.plans.stats import CorpusStats
from corploom.sources import DocumentStream, chain, from_table, read

__all__ = ["Corpus", "CorpusStats", "Document", "DocumentStream", "chain", "from_table", "read"]
