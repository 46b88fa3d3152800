"""Fixed values of the vehicle tracking rules. They have to be these for right results."""

# The served area and the anchor of the flat projection, in degrees; metres per degree there.
AREA_LAT, AREA_LON = (-23.15, -22.65), (-43.90, -43.00)
ANCHOR_LAT, ANCHOR_LON = -22.9, -43.4
M_PER_LAT, M_PER_LON = 111194.92664455873, 102431.14359791845

# Seconds and metres of the hygiene rules.
FUTURE_S, TOO_OLD_S, DEDUPE_S, STALE_S, DROP_S = 60, 300, 600, 180, 300
MAX_SPEED_MS, MIN_GAP_S, HALF_LIFE_S, MOVING_MS, STOPPED_MS = 27.0, 10.0, 60.0, 1.5, 0.83
PARKED_M, PARKED_S, OFF_ROUTE_S, GARAGE_ROUTE_M, TERMINAL_M = 100.0, 600, 600, 35.0, 250.0

# The matcher.
CONFIDENT_M, TENTATIVE_M, BACKWARD_M, PROGRESS_M, FIXES, SEPARATION_M = 60.0, 200.0, 30.0, 100.0, 3, 300.0
BEAM, PER_SHAPE, MARGIN, DECAY, SPAWN, MOTION_WEIGHT, SLACK_M, BACKWARD_COST, HEADING_WEIGHT = 4, 4, 15.0, 0.7, 60.0, 0.5, 25.0, 150.0, 0.35

# Arrivals.
AHEAD_M, STOPS_AHEAD, MEDIAN_OF = 8000.0, 25, 3

# Codes by which operators say that a bus carries nobody.
OUT_OF_SERVICE = [
    "GARAGEM", "MANUTENCAO", "MANUTENÇÃO", "RESERVADO", "ESPECIAL", "APOIO", "FORA DE OP", "FORA DE OPERACAO", "FORA DE OPERAÇÃO",
    "RECOLHE", "RECOLHIDO", "TREINAMENTO", "TREINO", "VISTORIA", "SEM LINHA", "MANUTENçãO", "FORA DE OPERAçãO",
]
VENDORS = ["zirix", "conecta", "maxtrack", "sonda"]

# The evidence jobs' own projection (metres per degree of latitude, and the latitude of its cosine), their cells,
# the speed up to which a report counts as standing, the buses of a dense cell, and what tells a garage from a terminal.
EVIDENCE_M_PER_DEGREE, EVIDENCE_LAT = 111320.0, -22.9
NIGHT_CELL_M, NIGHT_MARGIN_M, SLOW_KMH, DENSE_BUSES = 60.0, 30.0, 3.0, 6
GARAGE_BUSES, GARAGE_AWAY_BUSES, TERMINAL_END_M = 40, 20, 150.0
NIGHT_TIMES = ("06:00", "07:00")
# How near a route a fix covers it, the cells of routes, and how many fixes of a code are looked at.
COVER_M, COVER_CELL_M, SAMPLED = 60.0, 100.0, 600
