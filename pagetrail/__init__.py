"""Finds enrolled people's data in crawled pages and documents, and tracks its removal: Spark jobs."""
