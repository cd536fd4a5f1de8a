"""Operators over files, lines, symbols and import edges."""
