"""marketloom: a point-in-time market research engine on PySpark."""
