"""Part of lectio; see the README for the map."""
