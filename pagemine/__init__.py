"""Learn how websites are laid out from their stored pages, on Spark."""
