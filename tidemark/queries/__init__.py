"""The engine's operators applied to the driver's tables."""
