"""User functions and operators registered by name."""
