"""Part of the plumbline engine."""
