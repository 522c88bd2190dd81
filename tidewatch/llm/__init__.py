"""Training-data operators: ten ways to clean, score, mix and store a text corpus.

Nothing outside this package imports it. Every operator takes DataFrames and
returns DataFrames; ``registry`` holds the thin queries over the sample tables.
"""
