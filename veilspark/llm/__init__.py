"""Operators for preparing training text. Nothing else in veilspark imports this subpackage."""
