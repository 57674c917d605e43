"""Unbounded sources: the steps that judge each document on its own."""
