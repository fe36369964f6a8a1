"""Training-data operators. Nothing else in the library imports this subpackage.

Every operator module exposes DataFrame functions; `queries` registers the thin `opN_*` queries.
"""
