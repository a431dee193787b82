"""Deliberately empty: every supported computation reads complete, dated files.

Late information is modelled by availability dates and resolved with the
as-of joins in ``panelwright.operators.asof``.
"""
