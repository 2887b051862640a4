"""Frames that Spark derives from the base tables, and the registered queries over them."""
