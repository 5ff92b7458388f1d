"""Query plans; importing the query modules registers them."""
