"""Placement of files, configuration and the session facade."""
