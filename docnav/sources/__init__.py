"""sources of docnav."""
