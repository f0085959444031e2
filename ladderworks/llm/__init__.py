"""Training-data operators: ten components for corpora of documents, web pages and archives.

Nothing outside this subpackage imports it.
"""
