"""Preparation and evaluation of long-form text as DataFrame operations."""
