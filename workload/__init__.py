"""Registered queries: the library's operators over relations derived from the driver tables."""
