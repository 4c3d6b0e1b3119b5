"""Registered queries: each module offers QUERIES {name: callable} and SQL {name: text}."""
