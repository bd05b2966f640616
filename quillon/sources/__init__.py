"""Inputs: raw review files and tables that stand in for them."""
