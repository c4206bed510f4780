"""Conversation-memory retrieval analytics as PySpark DataFrame jobs."""
