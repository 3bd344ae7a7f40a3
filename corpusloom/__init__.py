"""corpusloom: retrieval and corpus analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrames to a DataFrame.  Nothing in
this package starts a session; callers pass their own.
"""
