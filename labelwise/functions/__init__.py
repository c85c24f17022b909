"""Column-level functions (strip, tokenise, label rules, formatting)."""
