"""Readers of transcripts, archives, git logs and the tables of a folder."""
