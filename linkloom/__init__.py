"""Analytics over tables of links, captured pages and scans, as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; none keeps a session of its own.
"""
