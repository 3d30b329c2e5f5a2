"""Refusals and failures that a caller can report; the command line exits with 2 on them."""


class DiffError(Exception):
    pass
