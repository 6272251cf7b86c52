"""Relational operators over lexicon-shaped DataFrames."""
