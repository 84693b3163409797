"""Relational operators over cell, point, line and document tables."""
