"""Column-level building blocks: text preparation, lexicons, feature profiles, row shaping."""
