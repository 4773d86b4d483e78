"""Contact intelligence over web pages, written as Spark jobs."""
