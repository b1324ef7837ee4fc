"""Linking and aligning two descriptions of one event stream, as Spark DataFrame operators."""
