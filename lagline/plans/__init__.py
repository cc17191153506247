"""Window frames, feature specifications and the planner that turns them into few stages."""
