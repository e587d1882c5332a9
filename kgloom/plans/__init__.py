"""Stage runners and configuration."""
