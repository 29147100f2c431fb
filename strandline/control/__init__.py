"""The control table of streams, the decisions taken on it, and the supervisor that carries them out."""
