"""lexmill: Spark jobs that index, search, inspect and prepare large collections of code and text."""
