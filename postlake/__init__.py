"""postlake: collected job postings as Spark tables, streams and reports."""
