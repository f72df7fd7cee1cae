"""SQL checks for the registered queries."""
