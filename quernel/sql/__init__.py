"""The SQL surface: tokens, statements, parser."""
