"""Readers: each returns a DataFrame and checks what the format promises."""
