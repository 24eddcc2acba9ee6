class InvalidQuery(ValueError):
    """A query parameter that cannot be accepted; the message says which."""
