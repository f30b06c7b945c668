"""Operators composed into the stages of a study, each readable from and written to a folder."""
