"""Conversation analytics on PySpark DataFrames."""
