"""End-to-end workflows, run history, configuration and command line."""
