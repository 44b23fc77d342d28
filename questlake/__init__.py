"""Question-answering and search-agent data as DataFrame and SQL operators."""
