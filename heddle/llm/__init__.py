"""Operators for training data; an optional subpackage that nothing else imports."""
