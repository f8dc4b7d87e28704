"""Operators over the warehouse tables; each maps DataFrames to a DataFrame."""
