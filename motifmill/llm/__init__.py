"""Operators that prepare text for the training of language models; nothing else in the package imports them."""
