"""Control plane: configuration, artifacts, runner and result cards."""
