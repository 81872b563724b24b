"""Part of evigrid."""
