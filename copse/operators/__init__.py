"""Operators over node tables, witness tables and plain relations."""
