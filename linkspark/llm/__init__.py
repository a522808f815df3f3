"""Operators for preparing language-model training data.

Nothing outside this folder imports it. Texts cross to Python as Arrow
batches and are worked on as whole byte arrays (``bytescan``); everything
that has to meet across documents goes through DataFrame shuffles.
"""
