"""shoebox: curation of very large photo libraries as Spark jobs."""
