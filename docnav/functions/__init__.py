"""functions of docnav."""
