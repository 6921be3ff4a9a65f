"""Readers for establishment CSV, catalogues and venue documents."""

from poicraft.sources.readers import *  # noqa: F401,F403
