"""plans of docnav."""
