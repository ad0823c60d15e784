"""Table operators: take and return ``DataFrame``; joins, windows, aggregates, Arrow UDFs."""
