"""Initial conditions: generators of lattices and point clouds, and states made of tables."""
