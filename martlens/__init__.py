"""martlens: a star-schema sales mart and its analytics catalog on Spark.

Every public function takes and returns lazy DataFrames built from built-in
Spark SQL functions; nothing here uses a Python UDF.
"""
