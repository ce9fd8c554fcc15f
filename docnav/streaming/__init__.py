"""streaming of docnav."""
