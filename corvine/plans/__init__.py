"""The search planner and the registered queries with their SQL."""
