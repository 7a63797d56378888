"""Ranked fuzzy person-name search and text relevance on PySpark."""
