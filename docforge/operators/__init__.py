"""Relational operators over documents, pages, blocks, evidence, records and scores."""
