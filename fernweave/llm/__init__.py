"""Training-data pipeline operators.

Nothing outside this subpackage imports it; the folder can be deleted without
affecting the rest of the library.
"""
