"""Contest analytics on Spark: features, chances, tickets, settlement and reports."""
