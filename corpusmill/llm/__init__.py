"""Operators for preparing training data; the rest of the library never imports this subpackage."""
