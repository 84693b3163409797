"""Operators that prepare training text: sanitising, scanning, filtering, mixing, packing.

Nothing else in the library imports this subpackage.
"""
