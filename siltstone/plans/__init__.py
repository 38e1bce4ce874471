"""Plans of changes; nothing is carried out."""
