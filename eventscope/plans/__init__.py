"""Views, the linked domain, and the flows from raw data to answers."""
