"""Operators over timed, speaker-attributed relations."""
