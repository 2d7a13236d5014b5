"""Training-data operators: ten corpus-scale steps, each a DataFrame -> DataFrame function.

Nothing outside this subpackage imports it.
"""
