"""Statistics from distributed aggregates and moment matrices."""
