"""Table dumps, dump catalogs, retention and change replay as Spark jobs."""
