"""Training-data operators: deduplication, mixing, tokenising, scanning and scoring.

Nothing outside this folder imports it; ``queries.py`` lists the registered queries.
"""
