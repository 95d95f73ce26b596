"""Re-checks driven by changes."""
