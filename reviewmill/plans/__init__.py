"""Whole plans built from functions and operators."""
