"""Plan shapes that hold up on skewed and very large inputs."""
