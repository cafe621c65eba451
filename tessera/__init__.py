"""Repository and document knowledge as Spark plans."""
