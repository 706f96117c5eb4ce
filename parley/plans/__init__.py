"""Complete analyses: each composes operators into one lazy plan per result."""
