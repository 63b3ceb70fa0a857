"""Latent-driver interaction analytics and training-data preparation on Spark."""
