"""Control plane of the archive: lock, commit log, segments."""
