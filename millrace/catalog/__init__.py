"""The registered queries."""

from millrace.catalog import batches, chats, corpus, files, flows, scoring, text
from millrace.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "batches", "chats", "corpus", "files", "flows", "scoring", "text"]
