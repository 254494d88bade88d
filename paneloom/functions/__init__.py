"""Part of paneloom."""
