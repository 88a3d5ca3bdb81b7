"""Where triples and graph tables come from and go to."""
