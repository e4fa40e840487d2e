"""Sources of the phasing engine."""
