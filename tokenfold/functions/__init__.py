"""Part of the context-assembly engine."""
