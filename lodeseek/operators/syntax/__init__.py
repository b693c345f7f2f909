"""Syntax search without a parser for each language: token trees, and expressions found in them by precedence.

It is an approximation of search over syntax trees. Supported patterns and their limits are listed in the README.
"""
