"""Spark-native analytics for very large photo and video catalogues.

Every operator is a function from DataFrames to DataFrames: ``functions`` holds
column expressions, ``operators`` the relational work, ``sources`` the readers and
writers, ``plans`` the end-to-end jobs and the query registry, ``streaming`` the
Structured Streaming jobs.
"""
