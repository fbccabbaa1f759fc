"""Stripe pruning, and the queries of the driver contract."""
