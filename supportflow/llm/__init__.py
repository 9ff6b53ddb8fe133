"""Training-data operators over tables of documents and web pages.

One module per operator, each DataFrame in, DataFrame out; ``queries.py`` and ``oracle.py``
register them over the driver tables. Nothing else in the library imports this subpackage.
"""
