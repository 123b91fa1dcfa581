"""concord: reconciling damaged, repeated and incomplete copies of data on PySpark."""
