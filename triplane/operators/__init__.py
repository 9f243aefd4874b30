"""Relational operators over solution tables: joins, unions, solution modifiers."""
