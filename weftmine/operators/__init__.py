"""Operators over long (entity, item, value) DataFrames."""
