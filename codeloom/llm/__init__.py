"""Training-data operators: ten corpus-scale text operators, each in its own module.

Nothing else in the package imports from here; the folder can be removed as a whole.
"""
