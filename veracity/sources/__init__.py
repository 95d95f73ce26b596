"""Readers that give the tables of the model."""
