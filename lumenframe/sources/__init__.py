"""Where pixel relations come from and where results go."""
