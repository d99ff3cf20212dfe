"""Lectio: document retrieval and grounded question answering as Spark plans."""
