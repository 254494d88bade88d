"""Plan helpers shared by the operators: shared-folder tables, bounded joins and distributed ordinals."""
