from paneloom.sources import files, panels  # noqa: F401
