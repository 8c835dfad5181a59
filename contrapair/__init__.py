"""Paired-contrast measurement engine expressed as Spark DataFrame operators."""
