"""Reading and normalising of raw inputs."""
