"""operators of docnav."""
