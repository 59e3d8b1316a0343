"""Loamstack: structured-document retrieval and data preparation, declared as Spark plans."""
