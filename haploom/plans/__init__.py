"""Plans of the phasing engine."""
