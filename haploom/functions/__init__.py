"""Functions of the phasing engine."""
