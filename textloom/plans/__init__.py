"""End-to-end flows and the registry of queries."""
