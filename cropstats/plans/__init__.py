"""Jobs and the driver's star-schema queries."""
