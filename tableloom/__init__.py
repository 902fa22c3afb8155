"""Seeded table generation and dataset shaping as Spark DataFrame plans."""
