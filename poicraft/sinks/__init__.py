"""Distributed writers (K1–K7); nothing is assembled on the driver."""

from poicraft.sinks.writers import *  # noqa: F401,F403
