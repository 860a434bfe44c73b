"""Operators that prepare a training corpus. Nothing outside this package imports it."""
