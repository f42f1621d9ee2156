"""Jobs and the catalogue of registered queries."""
