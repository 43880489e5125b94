"""Quiremill: scholarly text and citation graphs on Spark."""
