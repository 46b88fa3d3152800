"""Fleet analytics on Spark: position hygiene, map matching, arrivals and schedule preparation."""
