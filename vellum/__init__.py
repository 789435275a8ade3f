"""Curation and scoring of documents as Spark plans."""
