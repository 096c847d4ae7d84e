"""Operators for training data made of source files and documents."""
