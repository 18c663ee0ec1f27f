"""From patterns and query files to DataFrame plans."""
