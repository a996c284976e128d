"""Tidemark: product-event analytics expressed as Spark DataFrame operators."""
