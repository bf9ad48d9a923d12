"""Rules, their registry and the registered queries."""
