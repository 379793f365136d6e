"""Anomaly models: isolation forest, autoencoder, ensemble."""
