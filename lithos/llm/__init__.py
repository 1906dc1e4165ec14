"""Training-data operators: one module per operator, thin queries in ``registry``.

Nothing outside this folder imports it. General helpers (the checkpoint folder, table scans)
come from the rest of the library.
"""
