"""Column functions: take and return ``Column``; native Catalyst expressions only."""
