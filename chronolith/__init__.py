"""Point-in-time analytics and corpus building on Spark."""
