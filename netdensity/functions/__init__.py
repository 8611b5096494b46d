"""Part of the netdensity package."""
