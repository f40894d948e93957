"""Developer and repository analytics as Spark DataFrame programs."""
