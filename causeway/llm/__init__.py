"""Operators for training data: mapping, matching, text forms, token ids, leaks and languages.

Nothing outside this subpackage imports it.
"""
