"""Training-data operators: near-duplicates, language models, archives, rules, packing and more.

Nothing outside this subpackage imports it.
"""
