"""Readers (``spark, path -> DataFrame``) and writers."""
