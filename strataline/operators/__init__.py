"""Relational operators over records, journals, transcripts and review state."""
