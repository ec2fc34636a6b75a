"""Errors that are the caller's to mend."""


class UserError(ValueError):
    """A request, mapping or document that can't be served as given."""
