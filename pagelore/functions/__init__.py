"""Part of pagelore."""
