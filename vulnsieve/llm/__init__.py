"""Operators of a training-data pipeline over document, page and embedding tables.

Nothing else in the library imports this subpackage.  Every operator selects the columns
it is given by name and returns columns of its own, so other columns of its input, also
ones with the names of its output, do not matter.
"""
