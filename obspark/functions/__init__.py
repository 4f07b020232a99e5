"""Part of the observation analytics library."""
