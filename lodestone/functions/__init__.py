"""Part of lodestone; see the README for the map of modules."""
