"""Token-budgeted context assembly for many conversations at once, as Spark plans."""
