"""Operators of a training-data pipeline: duplicates, tokens, secrets, toxicity, chats.

Nothing outside this folder and corpus_pipeline.py imports it.
"""
