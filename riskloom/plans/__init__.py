"""Plan builders and the query registry."""
