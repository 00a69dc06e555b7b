"""Tour analytics on Spark: imports, addresses, deliveries, plans and progress over many tours at once."""
