"""Query plans on the driver's tables (``catalog.load_all``) with their oracle SQL."""
