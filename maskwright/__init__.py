"""Sensitive text at scale: find, resolve, mask and measure spans with Spark."""
