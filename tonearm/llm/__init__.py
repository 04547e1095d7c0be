"""Operators for large training-data corpora, and their queries.

Nothing outside this folder imports it.  Every operator selects the columns
it needs before it does anything, so extra columns of any name do no harm.
"""
