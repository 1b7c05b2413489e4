"""Conversation analytics on Spark: declarative operators over segments, turns,
transcripts, vectors and meeting records."""
