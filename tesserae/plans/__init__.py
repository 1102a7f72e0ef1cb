"""Graph and recursive plans."""
