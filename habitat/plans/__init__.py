"""The study's stages, composed from operators and driven by the species table."""
