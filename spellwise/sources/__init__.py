"""Inputs: views of generic tables as employment histories, generators, and writers of results."""
