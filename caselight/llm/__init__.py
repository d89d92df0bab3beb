"""Operators on typed names, free text and documents for training data. Nothing else in the library imports this package."""
