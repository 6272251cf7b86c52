"""Query plans: operators bound to tables."""
