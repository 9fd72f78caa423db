"""Part of framelake."""
