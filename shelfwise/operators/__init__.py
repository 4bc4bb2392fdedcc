"""DataFrame operators: intake, catalogue queries, numbering and command replay."""
