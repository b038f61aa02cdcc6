"""Whole plans: from texts to identities, and the queries over the driver's tables."""
