"""Operators for preparing training data, each over whole tables of texts."""
