"""How reports run: sessions, level-by-level walks, skewed joins, bundles."""
