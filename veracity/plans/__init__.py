"""Analyzers and services as DataFrame plans."""
