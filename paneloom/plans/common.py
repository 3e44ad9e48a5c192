"""Stand-in parameters of the registered queries."""

from __future__ import annotations

# Items play the part of commodities; the leader and its shock play the part of an export ban.
ITEMS = {"PROMO": "promo", "ECONOMY": "economy", "STANDARD": "standard"}
ALL_ITEMS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
LEADER = "NATION_3"
SHOCK_ITEM = "PROMO"
SHOCK_YEAR = 1998
T0 = 1997
ELEMENTS = {"Import Value": "imp_val", "Import Quantity": "imp_quant", "Export Value": "exp_val", "Export Quantity": "exp_quant"}
