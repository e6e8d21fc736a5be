"""Relational operators of the engine, DataFrames in and out."""
