"""Where results go: payloads, pictures, tables."""
