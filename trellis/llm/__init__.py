"""Training-data operators: text in, training-ready sequences out.

Nothing outside this folder imports it; ``queries.py`` registers one query per
operator and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
