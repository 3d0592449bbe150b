"""tallyframe: table profiling, analysis and tabular ML as Spark jobs.

Every operator takes DataFrames and returns DataFrames built from Spark SQL
expressions; see README.md for the map from task to function.
"""
