from paneloom.functions import aggregates, scalars  # noqa: F401
