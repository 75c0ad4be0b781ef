"""histoframe: tissue-cytometry tables and corpus preparation as Spark jobs."""
