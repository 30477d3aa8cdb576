"""Operators for preparing training text: detection, deduplication, search, scoring, mixing.

The rest of the library does not import this subpackage.
"""
