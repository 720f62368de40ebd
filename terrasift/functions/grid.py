"""Fixed values of the cell grid and of the search assumptions, used by every module."""

# --- fixed values (must equal the published data model) ---
N = 512                 # cells per window side
CELL = 30.0             # metres per cell
ZONE = 16               # cells per zone side
ZONES = 32              # zones per window side
LATTICE = 64            # window origins lie on this lattice
OUTSIDE_CELL = N * N    # sentinel id of everything outside the window
MASTER_ROWS, MASTER_COLS = 3200, 2368
EARTH_M = 6371008.8
SCENARIO_WEIGHTS = {"a": 0.5, "b": 0.25, "b2": 0.25}
WIDTHS = [8.0, 15.0, 22.0]          # detection widths, metres
GPS_SIGMA_M = 10.0
MOBILITY = 0.42
FACILITY_SCALE_S = 900.0
MAX_BIAS = 0.7
MAX_TEAM, MIN_SPACING, MAX_SPACING = 12, 3.0, 60.0
SPEED_EDGES = [0.0, 0.25, 0.75, 1.25, 1.75, 2.5, 4.0]
BIN_SECONDS = 60
REFRESH_SECONDS, MAX_FORECAST_S = 15, 6 * 3600
SEARCH_TYPES = ["hasty", "sweep", "paired"]
# standard normal quantiles at .5, .8 and .95
Z50, Z80, Z95 = 0.0, 0.8416212335729143, 1.6448536269514722
# --- end of fixed values ---
