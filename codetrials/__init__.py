"""Coding-task corpus analytics as Spark DataFrame operators."""
