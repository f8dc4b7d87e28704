"""Column expressions shared by the sources and operators. No Python UDFs."""
