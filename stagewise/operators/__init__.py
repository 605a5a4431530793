"""Operators: parsing, reshaping, lookups, merging, validation, prompts and extraction."""
