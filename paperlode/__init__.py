"""Document search and text processing as Spark plans."""
