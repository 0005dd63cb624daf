"""gridloom: chunked n-dimensional arrays as Spark DataFrame plans."""
