"""DataFrame operators over annotation and segment tables."""
