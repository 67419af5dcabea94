"""Operators for building training corpora from a table of documents.

Every operator takes DataFrames and returns a DataFrame. ``documents`` has the columns ``doc_id``,
``text``, ``lang``, ``source`` and ``n_chars``; an operator reads only the columns it needs, so further
columns of any name do no harm. Nothing else in the library imports this subpackage.
"""
