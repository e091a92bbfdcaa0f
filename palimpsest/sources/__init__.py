"""Where traces come from."""
