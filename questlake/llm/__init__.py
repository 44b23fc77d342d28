"""Training-data operators; queries and SQL are in ``registry``. Nothing else in the library imports this."""
