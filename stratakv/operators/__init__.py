"""Policies, merges and reads of versions, each a function from DataFrame to DataFrame."""
