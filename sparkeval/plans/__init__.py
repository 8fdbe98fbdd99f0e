"""How the operators stay distributed: skew, global order, shared storage."""
