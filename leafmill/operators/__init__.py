"""Relational operators over document collections: DataFrame in, DataFrame out."""
