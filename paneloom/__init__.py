"""paneloom: weighted, missing-aware panel analytics expressed as Spark DataFrame plans."""
