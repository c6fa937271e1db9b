"""The page flow and the event flow as streams."""
