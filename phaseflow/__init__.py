"""Phased network-flow analytics expressed as PySpark DataFrame plans."""
