"""Training-data operators: sharding, mixing, filters, decontamination, de-duplication, classifiers and exact search.

Nothing else in the library imports this subpackage.
"""
