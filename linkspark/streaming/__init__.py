"""The same operators over unbounded inputs."""
