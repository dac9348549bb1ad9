"""Retail inventory analytics on Spark: load, model, analyse, check."""
