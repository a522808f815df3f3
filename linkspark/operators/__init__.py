"""DataFrame-to-DataFrame operators over linked documents."""
